"""Selections: the positions whose value meets a condition. Over a scan the condition reaches Parquet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.primitives import COMPARE, PLAIN, compare_bound, is_pattern

Compare = str | Callable[[Column, Column], Column]


def condition(op: Compare, value: Column, bound: int | Column, patterns: bool = True) -> Column:
    """``op`` is a name of ``COMPARE`` or any function of two columns.

    Whole numbers are unsigned: with ``patterns``, named comparisons take longs as 64-bit patterns, so that
    those from 2 ** 63 on are the largest. Other values compare as they are.
    """
    if not isinstance(op, str):
        return op(value, bound if isinstance(bound, Column) else F.lit(bound))
    if not patterns:
        return PLAIN[op](value, bound if isinstance(bound, Column) else F.lit(bound))
    return COMPARE[op](value, bound) if isinstance(bound, Column) else compare_bound(op, value, bound)


def _condition(column: DataFrame, op: Compare, value: str, bound: int | Column) -> Column:
    return condition(op, F.col(value), bound, is_pattern(column.schema[value].dataType))


def select(column: DataFrame, op: Compare, bound: int | Column, value: str = "v", pos: str = "pos") -> DataFrame:
    """Positions with ``op(value, bound)``, as a frame (pos); ascending once ordered by ``pos``."""
    return column.where(_condition(column, op, value, bound)).select(F.col(pos).alias("pos"))


def between(column: DataFrame, low: int, high: int, low_op: Compare = "greaterequal", high_op: Compare = "less", value: str = "v", pos: str = "pos") -> DataFrame:
    """Positions with both ``low_op(value, low)`` and ``high_op(value, high)``."""
    both = _condition(column, low_op, value, low) & _condition(column, high_op, value, high)
    return column.where(both).select(F.col(pos).alias("pos"))


def select_all(column: DataFrame, *conditions: Column, pos: str = "pos") -> DataFrame:
    """Conjunction over columns of one frame: one scan instead of an intersection of position lists."""
    return column.where(reduce(lambda a, b: a & b, conditions)).select(F.col(pos).alias("pos"))


def select_any(column: DataFrame, *conditions: Column, pos: str = "pos") -> DataFrame:
    """Disjunction over columns of one frame: one scan instead of a union of position lists."""
    return column.where(reduce(lambda a, b: a | b, conditions)).select(F.col(pos).alias("pos"))
