"""The lookup table and what it promises: equal parts, few moves, the same place every time."""

import collections
import hashlib

import pytest

from colstride.llm import queries, sharding

NAMES = [f"s{k}" for k in range(20)]


def test_equal_parts_and_any_order():
    owner = sharding.fill(NAMES, 2003)
    counts = collections.Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 20
    shuffled = NAMES[::-1]
    assert [NAMES[k] for k in owner] == [shuffled[k] for k in sharding.fill(shuffled, 2003)]


def test_turns_follow_preferences():
    """Against a plain version with whole permutations."""
    names, slots = ["a", "b", "c"], 13
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    lists = [[(number("offset|" + s) % slots + j * (number("skip|" + s) % (slots - 1) + 1)) % slots for j in range(slots)] for s in names]
    table = {}
    while len(table) < slots:
        for k, preferred in enumerate(lists):
            free = [s for s in preferred if s not in table]
            if free:
                table[free[0]] = k
    assert sharding.fill(names, slots) == [table[s] for s in range(slots)]


def test_few_keys_move():
    before, after = sharding.fill(NAMES, 20011), sharding.fill(NAMES[:-1], 20011)
    moved = sum(NAMES[a] != NAMES[b] for a, b in zip(before, after) if NAMES[a] != NAMES[-1])
    assert moved < 0.1 * 20011


@pytest.mark.parametrize(("names", "slots"), [([], 13), (["a", "a"], 13), (["a"], 12), (["a", "b", "c"], 2), (["a"], 1_000_033)])
def test_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_placement(spark, tmp_path):
    rows = [(k, "x", "old") for k in range(300)] + [(5, "y", "old"), (None, "z", "old"), (None, "z", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    found = sharding.place(docs, NAMES, slots=2003)
    owner = sharding.fill(NAMES, 2003)
    assert found.columns == ["doc_id", "text", "slot", "shard"] and found.count() == 303
    for r in found.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 2003
        assert (r.slot, r.shard) == (slot, NAMES[owner[slot]])
    assert sharding.place(docs.limit(0), NAMES).count() == 0
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    sharding.write_shards(docs, str(tmp_path / "out"), NAMES[:3])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 303


def test_query(spark):
    found = queries.op2_sharding(spark, "/root/testdata/sf0.01")
    assert found.count() == 1000 and found.select("shard").distinct().count() > 200
