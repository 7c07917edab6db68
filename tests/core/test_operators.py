"""Golden fixtures of the operators, and edge cases of their semantics."""

import pytest
from pyspark.sql import functions as F

from colstride import operators as O
from colstride.functions import primitives as P
from colstride.functions import uint64 as U
from colstride.operators import grouping, joins, stats
from colstride.operators.calc import bitmap
from colstride.sources.columns import from_values


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def values(df):
    return [r.v for r in df.orderBy("pos").collect()]


def test_select(spark):
    column = from_values(spark, [95, 102, 100, 87, 120])
    assert rows(O.select(column, "less", 100)) == [(0,), (3,)]
    assert rows(O.select(column, "greaterequal", 102)) == [(1,), (4,)]
    assert rows(O.select(column, lambda a, b: a % 2 == b, 1)) == [(0,), (3,)]
    assert rows(O.between(column, 95, 102)) == [(0,), (2,)]
    assert rows(O.between(column, 95, 102, "greater", "lessequal")) == [(1,), (2,)]


def test_project(spark):
    data = from_values(spark, [11, 44, 22, 33, 11])
    at = spark.createDataFrame([(0, 4), (1, 1), (2, 4)], "n long, pos long")
    assert values(O.project(data, at, order="n")) == [11, 44, 11]
    assert values(O.project(data, from_values(spark, [1, 3, 4]).select(F.col("v").alias("pos"), F.col("pos").alias("n")), order="n")) == [44, 33, 11]
    outside = spark.createDataFrame([(0, 9)], "n long, pos long")
    assert values(O.project(data, outside, order="n")) == []
    with pytest.raises(Exception, match="out of range"):
        O.project(data, outside, order="n", strict=True).collect()


def test_joins(spark):
    left, right = from_values(spark, [22, 44, 11, 22, 55, 77]), from_values(spark, [33, 22, 22, 11])
    assert rows(O.nested_loop_join(left, right)) == [(0, 1), (0, 2), (2, 3), (3, 1), (3, 2)]
    assert rows(O.hash_join(left, right)) == [(0, 1), (0, 2), (2, 3)]
    left, right = from_values(spark, [11, 22, 33, 11, 44, 55]), from_values(spark, [22, 22, 33, 44, 33])
    assert rows(O.left_semi_join(left, right)) == [(1,), (2,), (4,)]
    assert rows(O.hash_semi_join(left, right)) == [(0,), (1,), (2,), (3,), (4,)]


@pytest.mark.parametrize("dense", [True, "ranges", "many"])
def test_group(spark, dense, monkeypatch):
    if dense == "many":
        monkeypatch.setattr(grouping, "MOST_ONCE", 1)
    ids, extents = O.group(from_values(spark, [333, 333, 111, 333, 222, 111]), dense=dense)
    assert [r.gid for r in ids.orderBy("pos").collect()] == [0, 0, 1, 0, 2, 1]
    assert rows(extents.select("gid", "rep")) == [(0, 0), (1, 2), (2, 4)]
    fine, reps = O.group_refine(ids, from_values(spark, [77, 88, 77, 77, 88, 88]), dense=dense)
    assert [r.gid for r in fine.orderBy("pos").collect()] == [0, 1, 2, 0, 3, 4]
    assert rows(reps.select("gid", "rep")) == [(0, 0), (1, 1), (2, 2), (3, 4), (4, 5)]
    with pytest.raises(ValueError):
        O.group_refine(ids, from_values(spark, [1]))


def test_sums(spark):
    data = from_values(spark, [100, 150, 50, 500, 200, 100])
    ids = spark.createDataFrame(list(enumerate([0, 0, 1, 0, 2, 1])), "pos long, gid long")
    assert rows(O.agg_sum(data)) == [(1100,)]
    assert rows(O.agg_sum(data.where("v < 0"))) == [(0,)]
    assert rows(O.agg_sum_grouped(ids, data, 3)) == [(0, 750), (1, 150), (2, 200)]
    large = from_values(spark, [-1, -1, 5])  # patterns of 2 ** 64 - 1
    assert rows(O.agg_sum(large)) == [(3,)] and rows(O.agg_sum(from_values(spark, [(1 << 63) - 1, 1]))) == [(-(1 << 63),)]
    assert rows(O.select(large, "less", 100)) == [(2,)] and rows(O.select(large, "greater", 100)) == [(0,), (1,)]
    with pytest.raises(ValueError):
        O.select(large, "less", -1)
    gap = spark.createDataFrame([(0, 0), (1, 2)], "pos long, gid long")
    assert rows(O.agg_sum_grouped(gap, from_values(spark, [5, 7]), 3)) == [(0, 5), (1, 0), (2, 7)]
    with pytest.raises(ValueError):
        O.agg_sum_grouped(gap, data, 3)


def test_sets(spark):
    a = from_values(spark, [1, 4, 5, 8, 9, 12]).select(F.col("v").alias("pos"))
    b = from_values(spark, [1, 6, 8, 12, 15]).select(F.col("v").alias("pos"))
    assert rows(O.intersect_sorted(a, b)) == [(1,), (8,), (12,)]
    assert rows(O.merge_sorted(a, b)) == [(x,) for x in (1, 4, 5, 6, 8, 9, 12, 15)]


def test_calc(spark):
    a, b = from_values(spark, [10, 20, 0, 3, 100]), from_values(spark, [5, 33, 3, 4, 10])
    assert values(O.calc_binary(a, b, "add")) == [15, 53, 3, 7, 110]
    assert values(O.calc_unary(a, lambda x: x + 5)) == [15, 25, 5, 8, 105]
    assert values(O.increment(a)) == [11, 21, 1, 4, 101]
    assert values(O.compare_binary(a, b, "less")) == [False, True, True, True, False]
    assert rows(bitmap(O.compare_binary(a, b, "less"))) == [(0, 0b1110)]
    with pytest.raises(ValueError):
        O.calc_binary(a, from_values(spark, [1]), "add")


TOP = (1 << 64) - 1


@pytest.mark.parametrize(
    ("op", "a", "b", "expected"),
    [
        (U.add, TOP, 5, 4), (U.sub, 3, 5, TOP - 1), (U.mul, TOP, TOP, 1), (U.mul, 10**10, 10**10, 10**20 % 2**64), (U.mul, 1 << 63, 3, 1 << 63),
        (U.div, TOP, 10, TOP // 10), (U.div, TOP, TOP, 1), (U.mod, TOP, 10, TOP % 10), (U.div, 7, 9, 0),
    ],
)
def test_unsigned(spark, op, a, b, expected):
    df = spark.createDataFrame([(str(a), str(b))], "a string, b string").select(F.col("a").cast("decimal(20,0)").alias("a"), F.col("b").cast("decimal(20,0)").alias("b"))
    assert int(df.select(op(F.col("a"), F.col("b"))).first()[0]) == expected


def test_unsigned_patterns(spark):
    df = spark.createDataFrame([(-1, 7), (7, -1), (-7, -1), (3, 5)], "a long, b long")
    assert [r[0] for r in df.select(U.bits_less(F.col("a"), F.col("b"))).collect()] == [False, True, True, True]
    back = df.select(U.from_bits(F.col("a")).alias("d")).select("d", U.to_bits(F.col("d")).alias("a"))
    assert [(int(r.d), r.a) for r in back.collect()] == [(TOP, -1), (7, 7), (TOP - 6, -7), (3, 3)]
    assert int(df.limit(1).select(U.neg(F.lit(7))).first()[0]) == 2**64 - 7
    assert int(df.limit(1).select(U.neg(F.lit(0))).first()[0]) == 0


def test_widths(spark):
    df = spark.createDataFrame([(0,), (63,), (-1,), (256,)], "v long")
    found = df.select(U.bitwidth(F.col("v")), U.bytewidth(F.col("v")), U.zero_bytes(F.col("v")), U.count_leading_zero(F.col("v"))).collect()
    assert [tuple(r) for r in found] == [(1, 1, 7, 64), (6, 1, 7, 58), (64, 8, 0, 0), (9, 2, 6, 55)]
    assert (U.bitwidth_min(1), U.bitwidth_min(5), U.bitwidth_max(5), U.bitwidth_max(64)) == (0, 16, 31, TOP)
    assert (U.round_up_div(7, 2), U.round_up_to_multiple(7, 4), U.round_down_to_multiple(7, 4)) == (4, 8, 4)


def test_shifts(spark):
    row = spark.range(1).select(U.shift_left(F.lit(1), F.lit(64)), U.shift_left(F.lit(1), F.lit(63)), U.shift_right(F.lit(-1), F.lit(63)), U.shift_right(F.lit(-1), F.lit(64))).first()
    assert tuple(row) == (0, -(1 << 63), 1, 0)


def test_lanes(spark):
    r = F.array(*[F.lit(x).cast("long") for x in (3, 1, 2, 6)])
    row = spark.range(1).select(
        P.hadd(r), P.hor(r), P.rotate(r), P.extract_value(r, 2), P.compressstore(r, F.lit(0b1010).cast("long")), P.mask_of(F.transform(r, lambda x: x > 2)),
        P.count_matches(F.lit(0b1011).cast("long")), P.lanes(r, r, lambda a, b: a * b), P.set_sequence(F.lit(5), F.lit(2), 3), P.set1(F.lit(9), 2),
    ).first()
    assert [list(x) if isinstance(x, list) else x for x in row] == [12, 7, [1, 2, 6, 3], 2, [1, 6], 0b1001, 3, [9, 1, 4, 36], [5, 7, 9], [9, 9]]


def test_statistics(spark):
    p = stats.data_properties(from_values(spark, [1, 1, 2, 9]))
    assert (p.count, p.least, p.greatest, p.histogram, p.sorted_ascending, p.distinct, p.unique) == (4, 1, 9, {1: 2, 2: 1, 4: 1}, True, 3, False)
    assert stats.is_sorted(from_values(spark, [9, 4, 4, 1]), descending=True)
    assert not stats.is_sorted(from_values(spark, [1, 3, 2]))
    far = spark.createDataFrame([(65535, 5), (65536, 4)], "pos long, v long")
    assert not stats.is_sorted(far)
    assert stats.is_unique(from_values(spark, [1, 2])) and not stats.is_unique(from_values(spark, [2, 2]))
    assert stats.is_unique_estimate(from_values(spark, [1, 2, 2]), first=2)
    assert rows(stats.max_bitwidth(from_values(spark, [1, 8, 3]))) == [(4,)]
    assert rows(O.distinct_values(from_values(spark, [7, 3, 7]))) == [(0, 7), (1, 3)]


def test_pairs_of_frequent_keys_are_dealt_by_pairs(spark, monkeypatch):
    """One input partition; the rows of a frequent key meet in many tasks, and no pair is lost or doubled."""
    monkeypatch.setattr(joins, "HOT_PAIRS", 50)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 7)
    monkeypatch.setattr(joins, "TASK_PAIRS", 100)
    keys = [None, *[1] * 40, *[2] * 3, 3, *[4] * 9]
    side = lambda rows: spark.createDataFrame(rows, "pos long, v long").coalesce(1)
    left, right = [(i, k) for i, k in enumerate(keys)], [(i if i % 5 else None, k) for i, k in enumerate(keys + [4] * 20 + [5])]
    found = joins.nested_loop_join(side(left), side(right))
    pairs = lambda rows: sorted(rows, key=str)
    assert pairs(tuple(r) for r in found.collect()) == pairs((a, b) for a, k in left for b, m in right if k is not None and k == m)
    assert found.rdd.getNumPartitions() >= (40 * 40 + 9 * 29) // 100
