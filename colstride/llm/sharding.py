"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table,
each in the order of its own permutation, and a key's hash picks a slot. Shards get equal parts, and when
one comes or goes few keys move between the others. The table is small and fixed in size, so it is
broadcast and a key finds its shard in constant time, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, over a hundred times the usual number of shards, which keeps their parts within a percent.
SLOTS = 65537
#: Most slots that are broadcast; larger tables are refused.
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its index) of each slot.

    A shard prefers the slots offset, offset + skip, offset + 2 skip, ... modulo the prime, which visits
    all of them. In turns, each claims the first slot of its preference that is still free. The result
    depends on the names alone, not on their order.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names of their own")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    order = sorted(range(len(shards)), key=lambda k: shards[k])
    at = [_number("offset|" + s) % slots for s in shards]
    skip = [_number("skip|" + s) % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for k in order:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key by 60 bits of an MD5 of its text; a null key has that of the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` (long) and ``shard`` (a name), one row per row.

    Equal keys meet in one shard, null keys in that of the empty text; an empty table gives an empty
    result; columns of these names are replaced. Nothing is shuffled.
    """
    keep = [c for c in docs.columns if c not in ("slot", "shard")]
    owner = fill(shards, slots)
    table = docs.sparkSession.createDataFrame([(s, shards[k]) for s, k in enumerate(owner)], "slot long, shard string")
    placed = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("slot", slot_of(docs[f"`{key}`"], slots))
    # At most MOST_SLOTS rows of a number and a name.
    return placed.join(F.broadcast(table), "slot").select(*keep, "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id", files: int = 8, slots: int = SLOTS) -> None:
    """Write the documents to one folder per shard, in ``files`` files each at most: rows are dealt by
    shard and a hash of the key, so that no task holds a whole shard."""
    placed = place(docs, shards, key, slots).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(files)))
    placed.repartition(len(shards) * files, "shard", "_part").drop("_part", "slot").write.partitionBy("shard").parquet(path)
