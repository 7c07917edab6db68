"""Near-duplicate documents and embeddings against brute force, and their edge cases."""

import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colstride.llm import _graph, _shared, embeddings, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def shingle_set(text, width):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[k:] for k in range(width)])) if len(words) >= width else frozenset([tuple(words)])


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts, width, percent):
    sets = {i: shingle_set(t, width) for i, t in texts}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(sets, linked).items()}


def copies(seed, n=60):
    """A base text and copies with a word changed here and there, short ones and exact ones among them."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts = []
    for _ in range(6):
        base = list(rng.choice(vocab, 120))
        for _ in range(n // 6):
            words = base.copy()
            for k in rng.integers(0, 120, rng.integers(0, 9)):
                words[k] = rng.choice(vocab)
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_documents_against_brute_force(spark, width, percent):
    texts = copies(1) + copies(2)[:20] + ["", None, " \t\n", "one two", "One  TWO", "one two three", "É x y z", "é x y z"]
    texts += [texts[0], texts[5]] * 3
    pairs = list(enumerate(texts, 10))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], "doc_id long, text string, id string, component int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width, percent).collect()}
    assert found == brute(pairs, width, percent)
    left = neardup.first_of_each(docs, width, percent)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in found.items() if i == c)


def test_query_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    found = neardup.near_duplicates(docs, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(pairs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_groups_are_split_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    pairs = list(enumerate(copies(3, 90)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()} == brute(pairs, 3, 85)


def thue_morse(n, swap=False):
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


def test_words_that_collide_under_weak_hashes(spark):
    a, b = thue_morse(1024), thue_morse(1024, True)
    pairs = [(1, a), (2, b), (3, f"x {a} y {b} z"), (4, f"x {b} y {a} z"), (5, f"x {a} y {b} z")]
    found = neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(pairs, 3, 85)


def test_sets_with_a_shared_half():
    pairs = np.array([[5, 5, 7, 5, 9, 7], [1, 2, 3, 1, 4, 3]], dtype=np.uint64)
    a = neardup.distinct(pairs)
    assert sorted(zip(*a.tolist())) == [(5, 1), (5, 2), (7, 3), (9, 4)]
    b = neardup.distinct(np.array([[5, 7, 9, 1, 2], [2, 9, 4, 1, 1]], dtype=np.uint64))
    assert neardup.common_size(a, b) == neardup.common_size(b, a) == 2


def test_hot_keys_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 3)
    monkeypatch.setattr(_shared, "HOT_FRACTION", 10)
    pairs = list(enumerate(copies(4, 60)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()} == brute(pairs, 3, 85)
    star = [(0, i) for i in range(1, 60)] + [(70, i) for i in range(40, 60)] + [(80, 81)]
    found = {r.id: r.component for r in _graph.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(60)}, 70: 0, 80: 80, 81: 80}


def test_tables_of_full_sets_go_once_used(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(_shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    seen, stored = {}, _shared.stored

    def watched(df, label="t"):
        seen.setdefault(label, {p.name.split("-")[0] for p in tmp_path.iterdir()})
        return stored(df, label)

    monkeypatch.setattr(_shared, "stored", watched)
    pairs = list(enumerate(copies(7, 40)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()} == brute(pairs, 3, 85)
    assert "sets" in seen["stars"] and not seen["first"] & {"sets", "pairs", "wanted"}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_full_sets_are_dealt_once(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_BROADCAST", most)
    status = spark.sparkContext._jsc.sc().statusStore()
    handed, dealt, stored, tiled = [], {}, _shared.stored, neardup.tiled

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    def watched(df, label="t"):
        before = stages()
        out = stored(df, label)
        dealt[label] = sum(n for k, n in stages().items() if k not in before)
        return out

    def counted(rows, schema, work):
        handed.append((rows.count(), rows.where("grams IS NOT NULL").count()) if "grams" in rows.columns else (0, 0))
        return tiled(rows, schema, work)

    monkeypatch.setattr(_shared, "stored", watched)
    monkeypatch.setattr(neardup, "tiled", counted)
    pairs = list(enumerate(copies(3, 90)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    with _shared.settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert found == brute(pairs, 3, 85)
    (stars, _), _, (rest, sets) = handed
    assert stars and sets
    # To their tiles, and nowhere else.
    assert dealt["stars"] == stars and dealt["rest"] == rest


def test_no_rows_null_ids_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], schema)
    found = sorted(tuple(r) for r in neardup.near_duplicates(docs).select("component_id", "kept", F.col("doc_id").isNull()).collect() if r.component_id)
    assert found == [(3, False, False), (3, True, False), (3, True, False)]
    assert neardup.near_duplicates(docs).where("doc_id IS NULL AND component_id IS NULL AND kept").count() == 1


def test_repeated_rows_leave_one(spark):
    schema = "doc_id long, text string, note string"
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, None, "z"), (None, None, "z"), (3, "a b c d e f", "p"), (3, "a b c d e f", "p"), (4, "a b c d e f", "q"), (5, "u v w x y z", "r"), (5, "other text here", "s")]
    left = sorted(str((r.doc_id, r.text)) for r in neardup.first_of_each(spark.createDataFrame(rows, schema)).collect())
    assert left == sorted(map(str, [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (5, "u v w x y z"), (5, "other text here")]))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 63, 900, dtype=np.uint64) for _ in range(2))
    a[:600] = b[:600]
    a, b = np.unique(a), np.unique(b)
    ra, rb, union = neardup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == union).all()
    assert abs((ra == rb).mean() - 0.5) < 0.13
    same, more = int((ra == rb).sum()), int((ra > rb).sum())
    args = (np.array([900.0]), np.array([900.0]), np.array([more]), np.array([neardup.REGISTERS - same - more]), np.array([same]))
    assert neardup.likely(*args, 0.3).all() and not neardup.likely(*args, 0.75).any()
    assert (neardup.sketches([np.zeros(0, dtype=np.uint64)]) == 0).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 102)]
    found = {r.id: r.component for r in _graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine=0.95):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, dtype=float)
            ok[i] = u / np.linalg.norm(u)
    linked = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    n = {i: sum(i in pair for pair in linked) for i, _ in rows}
    return {i: (n[i], c) for i, c in components([i for i, _ in rows], linked).items()}


@pytest.mark.parametrize("dim", [3, 16, 40])
def test_vectors_against_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_TILE", 16)
    monkeypatch.setattr(embeddings, "STRIP", 7)
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((6, dim))
    vectors = [list(map(float, centres[k % 6] + rng.standard_normal(dim) * 0.16)) for k in range(150)] + [list(map(float, rng.standard_normal(dim))) for _ in range(50)]
    vectors += [vectors[0], vectors[0], [x * 3 for x in vectors[1]], None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 0.0]]
    rows = list(enumerate(vectors, 5))
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rep string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert found == brute_vectors(rows)


def test_vector_tables(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    found = embeddings.near_duplicates(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    null = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], schema))
    assert {tuple(r) for r in null.collect()} == {(None, 0, None, True), (1, 0, 1, True)}


def test_vectors_are_not_copied_for_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_TILE", 32)
    monkeypatch.setattr(embeddings, "MOST_TILE", 32)
    monkeypatch.setattr(embeddings, "AT_ONCE", 1, raising=False)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((600, 32))
    vectors[300:320] = vectors[:20] + rng.standard_normal((20, 32)) * 0.05
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    status = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    last = max([stages().apply(k).stageId() for k in range(stages().size())], default=-1)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert found == brute_vectors(rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    now = stages()
    dealt = [s.shuffleWriteRecords() for s in map(now.apply, range(now.size())) if s.stageId() > last]
    # Once in each block, one after the other, however many other vectors a vector meets.
    assert max(dealt) <= len(rows)


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = manager.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = files()
    _shared.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    ids = {x for pair in links if pair[0] != pair[1] for x in pair}
    found = {r.id: r.component for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == components(ids, [p for p in links if p[0] != p[1]])
