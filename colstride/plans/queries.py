"""Two ways to write a query: with positions between operators, or fused into one plan.

Fusing a selection and a projection over one table into ``where`` removes the join by position, which
the optimiser could not drop by itself. The positional forms stay for checking and for inputs that are
position lists already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import agg_sum, project, select


def select_sum(table: DataFrame, op: str, bound: int, key: str, value: str) -> DataFrame:
    """SUM(value) WHERE op(key, bound), fused: a scan with a pushed filter and a partial sum."""
    from ..functions.primitives import is_pattern
    from ..operators.selection import condition

    return agg_sum(table.where(condition(op, F.col(key), bound, is_pattern(table.schema[key].dataType))), value)


def select_sum_positional(table: DataFrame, op: str, bound: int, key: str, value: str) -> DataFrame:
    """The same over position lists: select, project, sum."""
    positions = select(table, op, bound, value=key)
    return agg_sum(project(table, positions, value=value))


def grouped_join_having(
    fact: DataFrame, dimension: DataFrame, on: Column, condition: Column, keys: list[str], value: Column, least: int, having: str = "greater"
) -> DataFrame:
    """Selection on a dimension, join, grouping by several keys, sum, and a condition on the sums.

    Replaces chains of group refinements and of projections through group representatives.
    """
    from ..operators.selection import condition as compare

    joined = fact.join(dimension.where(condition), on)
    sums = joined.groupBy(*keys).agg(F.sum(value).cast("long").alias("total"))
    return sums.where(compare(having, F.col("total"), least))
