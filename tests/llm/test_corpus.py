"""Packing, mixing and the pipeline."""

import os
import re
import zlib

import numpy as np
import pytest
from plain_pii import Plain
from pyspark.sql import functions as F
from test_neardup import brute

import corpus_pipeline
from colstride.llm import _shared, mixing, packing, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 63, 64, 100, 700, 1365, 1366, 2048, 4095, 4096, 4097, 9999])
def test_cuts(n):
    pieces = packing.cuts(n)
    assert sum(k for _, k in pieces) == n
    assert all(4096 // (k + 1) <= size <= 4096 // k for k, size in pieces)


def check_packed(rows, texts, whole=True):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    ids = {i: np.array([*e.ids, 2], dtype="<u4") for i, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    for i, own in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist() and sum(r.length for r in pieces) == len(own)
        for r in pieces:
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    if not whole:
        return None
    padding = 0
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        size = sum(r.length for r in own)
        assert size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
    return padding / sum(r.length for r in rows)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packed(queries.op6_packing(spark, SF).collect(), texts) < 0.03


def test_packing_edges(spark):
    texts = {0: None, 1: "", 2: "a <|endoftext|>b don't 12 Élan İx ΣΑΣ", 3: "word " * 20000, 4: "x" * 9000, 5: "?", 6: "ab12 'tis ½"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, class string")
    rows = packing.pack(docs, queries.vocabulary(), with_ids=True).collect()
    check_packed(rows, texts)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0
    twice = packing.pack(docs.where("doc_id = 5").union(docs.where("doc_id = 5")), queries.vocabulary()).collect()
    assert len(twice) == 2


def water(sizes, epochs=3.0):
    """Reshare the excess by weight, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, full, left = {s: 0.0 for s in names}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", None, "é", "Z", "aa", "tiny"]
    rows = [(i, names[min(6, int(rng.integers(0, 9)))], "w " * int(rng.integers(0, 300))) for i in range(400)]
    rows += [(1000, "tiny", "one"), (1001, "tiny", None), (1002, "only empty", ""), (1003, "b", "w " * 50), (1003, "b", "w " * 50)]
    docs = spark.createDataFrame([(i, t, s, 1) for i, s, t in rows], "doc_id long, text string, source string, size int")
    found = mixing.mix(docs).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = water(sizes)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert all(abs(words.get(s, 0) - target[s]) <= 1 for s in sizes)


def test_mixing_in_many_ranges_and_with_clashing_names(spark, monkeypatch):
    rows = [(i, "w " * (i % 40), "ab"[i % 5 == 0], i, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long, _SOURCE string")
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    out = sorted(map(tuple, mixing.apply_mix(docs).collect()))
    assert {r[3] for r in out} <= set(range(300)) and {r[4] for r in out} == {"x"} and all(r[0] == r[3] for r in out)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == few and sorted(map(tuple, mixing.apply_mix(docs).collect())) == out


def test_best_fit():
    rng = np.random.default_rng(3)
    for capacity in (7, 64, 4096):
        lengths = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        bins, offsets = packing.best_fit(lengths, capacity)
        room = {}
        for n, b, at in zip(lengths, bins, offsets):
            fits = [r for r in room.values() if r >= n]
            assert room.get(b, capacity) == (min(fits) if fits else capacity) and at == capacity - room.get(b, capacity)
            room[b] = room.get(b, capacity) - n
        assert sorted(room) == list(range(len(room)))


def test_scratch_tables_are_removed(spark):
    place = _shared.shared_dir(spark).removeprefix("file://")
    kept = _shared.stored(spark.range(3))
    before = set(os.listdir(place))
    with _shared.scratch(spark):
        assert _shared.stored(spark.range(5)).count() == 5 and len(os.listdir(place)) == len(before) + 1
    assert set(os.listdir(place)) == before and kept.count() == 3


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_pipeline(spark):
    """Each stage on what the one before kept, held against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "pii", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, SF)
        rows, schema = out.collect(), out.schema
        assert name == "packing" or out.columns == columns
        seen[name] = before, rows
        docs = spark.createDataFrame(rows, schema)
    before, rows = seen["language_id"]
    assert {r.doc_id for r in rows} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, rows = seen["minhash_dedup"]
    expected = brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in expected.items() if i == c)
    before, rows = seen["pii"]
    plain = Plain(pii.session_key(spark).secret)
    texts = {r.doc_id: plain.text(r.text)[0] for r in before}
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {i: (t, len(t)) for i, t in texts.items()}
    before, rows = seen["mixing"]
    sizes, taken = {}, {}
    for found, some in ((sizes, before), (taken, rows)):
        for r in some:
            found[r.source] = found.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in water(sizes).items())
    before, rows = seen["packing"]
    final = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, final.collect())) == sorted(map(key, rows))
    once = [r for r in before if sum(x.doc_id == r.doc_id for x in before) == 1]
    check_packed([r for r in rows if r.doc_id in {x.doc_id for x in once}], {r.doc_id: r.text for r in once}, whole=False)


@pytest.mark.parametrize("langs", [("en",), ("en", "fr"), ("de", "en", "es", "fr")])
def test_language_stage_rejects_what_no_language_has(spark, langs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(*langs))
    rng = np.random.default_rng(7)
    draw = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(60))
    planted = ["Это совершенно другой язык, и никто его здесь не знает. " * 5, "日本語のテキストはここにありますが" * 5, "이것은 전혀 다른 언어입니다 " * 9, "Αυτό είναι ένα κείμενο σε άλλη γλώσσα " * 5]
    planted += [draw("abcdefghijklmnopqrstuvwxyz") for _ in range(10)] + [draw("bcdfghjklmnpqrstvwxz") for _ in range(10)] + ["123 ... 456", "", None]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(rows, allowMissingColumns=True), SF).collect()}
    clean = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert kept == clean


def test_pipeline_stages_survive_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "the cat and the dog", "en", "a", 5), (2, "", "en", "a", 0), (2, "le chat et le chien", "fr", None, None), (2, "le chat et le chien", "fr", None, None), (3, "x" * 20000, "en", "b", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()
