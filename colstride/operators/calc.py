"""Element-wise calculation and comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uint64 as U
from ..functions.primitives import CALC, COMPARE, PLAIN, UNARY, is_pattern


def calc_unary(column: DataFrame, op: str | Callable[[Column], Column], value: str = "v", pos: str = "pos") -> DataFrame:
    """(pos, v) with ``op`` applied to each value: "inv" or any function of a column."""
    f = UNARY[op] if isinstance(op, str) else op
    return column.select(F.col(pos).alias("pos"), f(F.col(value)).alias("v"))


def increment(column: DataFrame, value: str = "v", pos: str = "pos") -> DataFrame:
    """(pos, v + 1); the largest unsigned number becomes 0."""
    # The only pattern whose successor is no long is that of 2 ** 63 - 1.
    return calc_unary(column, lambda x: F.when(x == (1 << 63) - 1, F.lit(-(1 << 63))).otherwise(x + 1), value, pos)


def paired(left: DataFrame, right: DataFrame, check: bool = True) -> DataFrame:
    """(pos, a, b) of two columns by position; raises when the lengths differ."""
    if check and left.count() != right.count():
        raise ValueError("both inputs must have the same length")
    return left.select("pos", F.col("v").alias("a")).join(right.select("pos", F.col("v").alias("b")), "pos")


def calc_binary(left: DataFrame, right: DataFrame, op: str | Callable[[Column, Column], Column], check: bool = True) -> DataFrame:
    """(pos, v) of two columns; "add", "sub", "mul", "div", "mod", "min" work modulo 2 ** 64.

    For columns of one frame use ``calc``, which joins nothing.
    """
    return _calculated(paired(left, right, check), op)


def calc(frame: DataFrame, op: str, a: str, b: str, pos: str = "pos") -> DataFrame:
    """(pos, v) of two columns of one frame: ``calc_binary`` without a join."""
    return _calculated(frame.select(F.col(pos).alias("pos"), F.col(a).alias("a"), F.col(b).alias("b")), op)


def compare(frame: DataFrame, op: str, a: str, b: str, pos: str = "pos") -> DataFrame:
    """(pos, v) with a boolean v of two columns of one frame."""
    both = all(is_pattern(frame.schema[c].dataType) for c in (a, b))
    return frame.select(F.col(pos).alias("pos"), (COMPARE if both else PLAIN)[op](F.col(a), F.col(b)).alias("v"))


def _calculated(pairs: DataFrame, op: str | Callable[[Column, Column], Column]) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    patterns = [is_pattern(pairs.schema[c].dataType) for c in ("a", "b")]
    if not isinstance(op, str):
        value = op(a, b)
    elif op == "min":
        value = U.least(a, b) if all(patterns) else F.least(a, b)
    else:
        # Sums, differences and products of patterns wrap to the same results as those of the numbers.
        a, b = (U.from_bits(c) if op in ("div", "mod") and is_bits else c for c, is_bits in zip((a, b), patterns, strict=True))
        value = CALC[op](a, b)
    return pairs.select("pos", value.alias("v"))


def _patterns(left: DataFrame, right: DataFrame) -> bool:
    return all(is_pattern(df.schema["v"].dataType) for df in (left, right))


def compare_binary(left: DataFrame, right: DataFrame, op: str | Callable[[Column, Column], Column], check: bool = True) -> DataFrame:
    """(pos, v) with a boolean v."""
    f = (COMPARE if _patterns(left, right) else PLAIN)[op] if isinstance(op, str) else op
    return paired(left, right, check).select("pos", f(F.col("a"), F.col("b")).alias("v"))


def bitmap(flags: DataFrame, value: str = "v") -> DataFrame:
    """(word, bits) of a boolean column: bit i of word w is the flag at position 64 w + i."""
    place = F.pmod(F.col("pos"), F.lit(64))
    bit = F.when(F.col(value), U.shift_left(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))
    return flags.groupBy(F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
