"""Harmonic packing of token sequences: lengths fall into reciprocal-capacity classes, and the bins of
class k hold exactly k pieces each, whatever worker found them.

A piece longer than capacity / (k + 1) and at most capacity / k belongs to class k. A document first
gives whole sequences; its rest stays in one piece where k such pieces fill a bin well, and else gives a
piece of exactly capacity / (k + 1) and goes on with what is left. Bins need no search: a piece's place
follows from its number within its class, and that from counts of each task. What is left over, less
than one bin of each class, is packed in one task: its size is bounded by the classes, not by the data.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _shared as S
from ._text import Growing, Segments, WordMemory, batches, places

#: Share of a bin that may stay empty when a rest is kept whole.
SLACK = 0.03
#: Words whose ids a worker remembers, and ids it holds for them.
MOST_WORDS, MOST_IDS = 900_000, 8_000_000
#: Words encoded in one call.
CALL_WORDS = 10_000
#: Signs that form pieces of their own around letters, whatever they are; no apostrophe, digit or "<".
SIGNS = '.,!?;:()"|#%&*$-'


def cuts(n: int, capacity: int = 4096, slack: float = SLACK) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of n ids, in order."""
    out = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append((k, rest))
            break
        out.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    return out


class WordTokens:
    """Ids of whole texts through a tokenizers file whose pieces never span white space: every distinct
    word is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool) if suffix else None
        if suffix:
            self.ends[[k for t, k in vocab.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.memory = WordMemory(MOST_WORDS)
        self.flat, self.start, self.length = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def plain(self, word: str) -> int:
        """Pieces of a word of letters between ASCII signs, told without the tokenizer; 0: can't tell."""
        core = word.strip(SIGNS)
        if not core:
            return 1
        if not core.lower().isalpha() or not (core.isascii() or unicodedata.is_normalized("NFC", core)):
            return 0
        at = word.index(core)
        return 1 + (at > 0) + (at + len(core) < len(word))

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Plain words go many in one call, joined by spaces, and the end marks of
        their pieces tell them apart; the others go one by one."""
        out: list = [None] * len(words)
        sizes = [self.plain(w) if self.ends is not None else 0 for w in words]
        plain = [i for i, n in enumerate(sizes) if n]
        for k in range(0, len(plain), CALL_WORDS):
            some = plain[k : k + CALL_WORDS]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, dtype=np.uint32)
            edge = np.flatnonzero(self.ends[ids]) + 1
            stop = edge[np.cumsum([sizes[i] for i in some]) - 1].tolist()
            for i, a, b in zip(some, [0, *stop[:-1]], stop, strict=True):
                out[i] = ids[a:b]
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.uint32)
        return out

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Encode the words and keep their ids; the number under which each is kept."""
        got = self.encode([w.decode("utf-8", "replace") for w in words])
        length = np.array([len(x) for x in got], dtype=np.int64)
        first = self.start.n
        self.start.extend(self.flat.n + np.cumsum(length) - length)
        self.length.extend(length)
        self.flat.extend(np.concatenate(got))
        return first + np.arange(len(words))

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for k, end in batches(texts, 1_000_000):
            # Words that are too long to be remembered leave ids behind.
            if self.memory.full or self.flat.n > MOST_IDS:
                self.clear()
            seen = Segments(texts[k:end])
            each = self.memory.values(seen, self.slots)
            length = self.length.room[each]
            total = np.concatenate([[0], np.cumsum(length)])
            flat = self.flat.room[places(self.start.room[each], length)]
            bounds = total[seen.first]
            for i in range(end - k):
                yield flat[bounds[i] : bounds[i + 1]]


_known: dict[str, WordTokens] = {}
S.CLEAR["packing"] = _known.clear


def word_tokens(path: str) -> WordTokens:
    if path not in _known:
        _known.clear()
        _known[path] = WordTokens(path)
    return _known[path]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, class, task, number[, ids]): the pieces of every
    document, numbered within their task and class."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("packing")
        tokens, task = word_tokens(path), TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        for batch in S.slices(batches_):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            rows, row, ids_out = [], 0, []
            for ids in tokens.ids(texts):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for k, n in cuts(len(ids), capacity):
                    piece = ids[at : at + n]
                    rows.append((row, at, n, zlib.crc32(piece.tobytes()), len(ids), k, numbers.get(k, 0)))
                    numbers[k] = numbers.get(k, 0) + 1
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    at += n
                row += 1
            if not rows:
                continue
            table = np.array(rows, dtype=np.int64).T
            columns = [batch.column(0).take(pa.array(table[0])), *[pa.array(c) for c in table[1:]], pa.array(np.full(len(rows), task))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "number", "task"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class long, number long, task long"
    return docs.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (where the piece
    begins in its sequence), and ``ids`` if asked for. Each document is its ids with ``end_id`` after
    them; every id lies in one piece. A null or empty text is its end id alone; rows with equal or
    null ids are packed as separate documents; an empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    base = S.small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # Written once: a task that ran again could number its pieces otherwise.
    found = S.stored(pieces(base, path, end_id, capacity, with_ids), "pieces")
    counts = found.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("class").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    totals = counts.groupBy("class").agg(F.sum("n").alias("n")).withColumn("bins", F.expr("n div class"))
    # One row per class, of which the capacity bounds the number.
    first_bin = F.coalesce(F.sum("bins").over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("first_bin", first_bin).withColumn("all_bins", F.sum("bins").over(W.partitionBy()))
    plan = starts.select("class", "task", "before").join(totals.select("class", "bins", "first_bin", "all_bins"), "class")
    placed = found.join(plan, ["class", "task"]).withColumn("place", F.col("before") + F.col("number"))
    placed = placed.withColumn("bin", F.expr("place div class"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    inside = W.partitionBy("class", "bin").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    full = placed.where("bin < bins").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    full = full.select(*columns, (F.col("first_bin") + F.col("bin")).alias("sequence_id"), "offset")
    left = placed.where("bin >= bins").select(*columns, "all_bins", "class", "place")
    schema = T.StructType([*[full.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def close(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches_ if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables).sort_by([("length", "descending"), ("class", "ascending"), ("place", "ascending")])
        bins, offsets = best_fit(table["length"].to_pylist(), capacity)
        base_bin = table["all_bins"][0].as_py()
        out = table.select(columns).append_column("sequence_id", pa.array([base_bin + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from out.to_batches()

    # Less than one bin of each class: bounded by the capacity.
    return full.unionByName(left.repartition(1).mapInArrow(close, schema))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length in the given order: in the bin with the least room that holds it."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, known, used = [], [], 0, 0
    for n in lengths:
        # Bit r of ``known`` is set where some bin has room r.
        if fits := known >> n:
            room = n + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                known ^= 1 << room
        else:
            room, at, used = capacity, used, used + 1
        bins.append(at)
        offsets.append(capacity - room)
        if room > n:
            with_room[room - n].append(at)
            known |= 1 << (room - n)
    return bins, offsets
