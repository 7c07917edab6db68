"""Generators, binary and Parquet columns, printing, and the variant harness."""

import pytest
from pyspark.sql import functions as F

from colstride.plans import harness
from colstride.plans import queries as plans
from colstride.sources import columns as C
from colstride.sources import generators as G
from colstride.streaming import running_sum


def values(df):
    return [r.v for r in df.orderBy("pos").collect()]


def test_sequences(spark):
    assert values(G.sorted_unique(spark, 4, 10, 3)) == [10, 13, 16, 19]
    assert values(G.sorted_unique(spark, 3, 7, 0)) == [7, 7, 7]
    drawn = values(G.sorted_unique_extraction(spark, 50, 200, 1))
    assert drawn == sorted(set(drawn)) and len(drawn) == 50 and max(drawn) < 200
    with pytest.raises(ValueError):
        G.sorted_unique_extraction(spark, 5, 4, 1)


def test_distributions(spark):
    u = values(G.with_distribution(spark, 2000, G.uniform(100, 200, 5)))
    assert min(u) >= 100 and max(u) <= 200 and 140 < sum(u) / len(u) < 160 and u == values(G.with_distribution(spark, 2000, G.uniform(100, 200, 5)))
    s = values(G.with_distribution(spark, 500, G.uniform(0, 9, 5), is_sorted=True))
    assert s == sorted(s)
    two = values(G.with_distribution(spark, 2000, G.two_values(1, 8, 0.25, 3)))
    assert set(two) == {1, 8} and 0.2 < two.count(8) / 2000 < 0.3
    mixed = values(G.with_distribution(spark, 2000, G.two_distributions(G.uniform(0, 9, 1), G.uniform(1000, 1009, 2), 0.5, 3)))
    assert 800 < sum(v >= 1000 for v in mixed) < 1200
    normal = values(G.rounded_real(spark, 3000, "normal", (50, 20), 0, 100, 9))
    assert min(normal) >= 0 and max(normal) <= 100 and 45 < sum(normal) / 3000 < 55 and normal == values(G.rounded_real(spark, 3000, "normal", (50, 20), 0, 100, 9))


def test_counts_and_widths(spark):
    exact = values(G.exact_number(spark, 300, 17, 5, 6, 2))
    assert exact.count(5) == 17 and exact.count(6) == 283
    for bad in ((3, 4, 1, 2), (5, 1, 3, 3)):
        with pytest.raises(ValueError):
            G.exact_number(spark, *bad, 1)
    weights = [0] * 64
    weights[2], weights[9], weights[40] = 1, 1, 1
    assert sum(G.histogram_counts(100, weights)) == 100
    widths = [v.bit_length() for v in values(G.with_bitwidths(spark, 99, weights, 4))]
    assert {w: widths.count(w) for w in set(widths)} == {3: 33, 10: 33, 41: 33}
    drawn = {v.bit_length() for v in values(G.with_bitwidths(spark, 300, weights, 4, exact=False))}
    assert drawn == {3, 10, 41}


def test_outliers(spark):
    v = values(G.with_outliers(spark, 4000, (10, 20), 0.3, (1000, 1010), 0.1, 8))
    assert 0.07 < sum(x >= 1000 for x in v) / 4000 < 0.13 and 0.26 < v.count(10) / 4000 < 0.34 and all(10 <= x <= 20 or 1000 <= x <= 1010 for x in v)
    for bad in (((5, 5), 0.1, (9, 10), 0.1), ((1, 9), 0.1, (9, 10), 0.1), ((1, 3), 0.1, (10, 9), 0.1), ((1, 3), -0.1, (9, 10), 0.1), ((1, 3), 0.1, (9, 10), 1.1), ((1, 3), 0.6, (9, 10), 0.5)):
        with pytest.raises(ValueError):
            G.with_outliers(spark, 10, *bad, 1)


def test_weights_file(spark, tmp_path):
    (tmp_path / "w").write_bytes(bytes(range(64)) + bytes(64))
    found = G.read_weights(spark, str(tmp_path / "w"))
    assert found.count() == 128 and found.where("histogram = 0 AND width = 5").first().weight == 4


def test_binary(spark, tmp_path):
    column = C.from_values(spark, list(range(300)))
    C.store_binary(column, str(tmp_path / "c.bin"))
    assert values(C.load_binary(spark, str(tmp_path / "c.bin"))) == list(range(300))
    (tmp_path / "short").write_bytes(b"\x05" + bytes(20))
    with pytest.raises(Exception, match="shorter"):
        C.load_binary(spark, str(tmp_path / "short")).collect()
    with pytest.raises(Exception):
        C.load_binary(spark, str(tmp_path / "none")).collect()


def test_positions_over_files(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "p"))
    found = C.from_parquet(spark, str(tmp_path / "p"), v="id")
    assert sorted(r.pos for r in found.collect()) == list(range(10))
    assert [r.pos for r in C.numbered(spark.range(20).select((19 - F.col("id")).alias("x")), "x").orderBy("x").collect()] == list(range(20))


def test_literals_printing_csv_cache(spark, tmp_path):
    with pytest.raises(ValueError):
        C.from_values(spark, range(401))
    a, b = C.from_values(spark, [1, 255]), C.from_values(spark, [7])
    text = C.printed([a, b], "hexadecimal", ["a", "b"])
    assert "00000000000000ff" in text and text.splitlines()[2].endswith("(end)")
    assert "1" * 8 in C.printed([a], "binary")
    for bad in ({}, {"a": a, "b": b}):
        with pytest.raises(ValueError):
            C.zipped(bad)
    C.write_csv({"a": a, "b": C.from_values(spark, [3, 4])}, str(tmp_path / "csv"), ";")
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).collect()) == [("1", "3"), ("255", "4")]
    cache = {}
    assert C.ensure_cached(a, "a", cache) is C.ensure_cached(b, "a", cache)
    C.clear_cache(cache)
    assert not cache


def test_harness(spark):
    table = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("x"), F.col("id").alias("y"))
    monitor = harness.Monitor()
    found = harness.run_variants(
        {
            "fused": lambda: plans.select_sum(table, "equal", 3, "x", "y"),
            "positional": lambda: plans.select_sum_positional(table, "equal", 3, "x", "y"),
            "wrong": lambda: plans.select_sum(table, "equal", 4, "x", "y"),
        },
        monitor,
    )
    assert found == {"fused": harness.GOOD, "positional": harness.GOOD, "wrong": harness.BAD}
    assert set(harness.run_variants({"a": lambda: table}, check=False).values()) == {harness.NOT_CHECKED}
    monitor.add("rows", 3)
    assert "rows: 3 (int)" in monitor.text() and monitor.csv().startswith("name,kind,value")
    assert harness.equal(table, table.select("y", "x", "pos")) and not harness.equal(table, table.limit(99)) and not harness.equal(table, table.select("x"))


def test_stream(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    seen = []
    q = running_sum(spark.readStream.schema("v long").parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.first().v), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == 45
