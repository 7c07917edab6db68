"""Properties of a column's data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import uint64 as U
from ..functions.primitives import COMPARE, PLAIN, is_pattern


@dataclass(frozen=True)
class DataProperties:
    count: int
    least: int | None
    greatest: int | None
    histogram: dict[int, int]
    sorted_ascending: bool
    distinct: int
    unique: bool


def histogram(column: DataFrame, value: str = "v") -> DataFrame:
    """(width, n): how many values need each number of bits."""
    return column.groupBy(U.bitwidth(F.col(value)).alias("width")).agg(F.count("*").alias("n"))


def max_bitwidth(column: DataFrame, value: str = "v") -> DataFrame:
    """One row (width): bits of the bitwise or of all values; 1 over no rows."""
    return column.agg(U.bitwidth(F.coalesce(F.bit_or(F.col(value)), F.lit(0).cast("long"))).alias("width"))


def _descents(column: DataFrame, value: str, pos: str, bad: Column) -> int:
    """Neighbours that break an order. Positions are cut into ranges, in which a window runs; the seams
    are compared apart, so no task sees all rows."""
    rows = column.select(F.col(pos).alias("p"), F.col(value).alias("x"), F.expr(f"`{pos}` div 65536").alias("r"))
    inside = rows.withColumn("b", F.lag("x").over(W.partitionBy("r").orderBy("p")))
    seams = rows.groupBy("r").agg(F.min_by("x", "p").alias("x"), F.max_by("x", "p").alias("last"))
    before = seams.select((F.col("r") + 1).alias("r"), F.col("last").alias("b"))
    across = seams.join(before, "r").select("x", "b")
    return inside.select("x", "b").union(across).where(bad).count()


def is_sorted(column: DataFrame, value: str = "v", pos: str = "pos", descending: bool = False) -> bool:
    """Whether values never fall (``descending``: never rise) with the position; ties are fine. Longs are patterns."""
    x, b = F.col("x"), F.col("b")
    less = COMPARE["less"] if is_pattern(column.schema[value].dataType) else PLAIN["less"]
    return _descents(column, value, pos, less(b, x) if descending else less(x, b)) == 0


def is_unique(column: DataFrame, value: str = "v") -> bool:
    row = column.agg(F.count("*").alias("n"), F.count_distinct(value).alias("d")).first()
    return row.n == row.d


def is_unique_estimate(column: DataFrame, value: str = "v", pos: str = "pos", first: int = 1000) -> bool:
    """Whether the first values are unique."""
    return is_unique(column.where(F.col(pos) < first), value)


def data_properties(column: DataFrame, value: str = "v", pos: str = "pos") -> DataProperties:
    # Longs are patterns: the least and greatest unsigned number, as numbers.
    flip = U.ordered if is_pattern(column.schema[value].dataType) else lambda c: c
    exact = (lambda c: U.from_bits(U.ordered(c))) if is_pattern(column.schema[value].dataType) else lambda c: c
    row = column.agg(F.count("*").alias("n"), exact(F.min(flip(F.col(value)))).alias("lo"), exact(F.max(flip(F.col(value)))).alias("hi"), F.count_distinct(value).alias("d")).first()
    widths = {r.width: r.n for r in histogram(column, value).collect()}  # at most 64 rows
    least, greatest = (None if x is None else int(x) for x in (row.lo, row.hi))
    return DataProperties(row.n, least, greatest, widths, is_sorted(column, value, pos), row.d, row.n == row.d)
