"""Grouping: dense group numbers in the order of first occurrence, and the first position of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.columns import numbered


#: Groups that one task numbers.
MOST_ONCE = 1_000_000


def extents_of(keys: DataFrame, names: list[str], pos: str = "pos", dense: bool = True) -> DataFrame:
    """(names..., rep, gid): one row per group.

    Rows are aggregated first. Up to ``MOST_ONCE`` groups are numbered in one ordered pass over them, more
    over ranges of them (``dense="ranges"``: always), so that no task sees very many.
    """
    groups = keys.groupBy(*names).agg(F.min(pos).alias("rep"))
    if dense != "ranges" and groups.count() <= MOST_ONCE:
        return groups.withColumn("gid", (F.row_number().over(W.orderBy("rep")) - 1).cast("long"))
    return numbered(groups, "rep").withColumnRenamed("pos", "gid")


def group(column: DataFrame, value: str = "v", pos: str = "pos", dense: bool | str = True) -> tuple[DataFrame, DataFrame]:
    """((pos, gid), (gid, rep)) of a column."""
    rows = column.select(F.col(pos).alias("pos"), F.col(value).alias("_k"))
    groups = extents_of(rows, ["_k"], dense=dense)
    return rows.join(groups, "_k").select("pos", "gid"), groups.select("gid", "rep")


def group_refine(ids: DataFrame, column: DataFrame, value: str = "v", pos: str = "pos", dense: bool | str = True, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Refine groups (pos, gid) by a further column; raises when the lengths differ."""
    if check and ids.count() != column.count():
        raise ValueError("both inputs must have the same length")
    rows = ids.select("pos", F.col("gid").alias("_g")).join(column.select(F.col(pos).alias("pos"), F.col(value).alias("_k")), "pos")
    groups = extents_of(rows, ["_g", "_k"], dense=dense)
    return rows.join(groups, ["_g", "_k"]).select("pos", "gid"), groups.select("gid", "rep")


def distinct_values(column: DataFrame, value: str = "v", pos: str = "pos") -> DataFrame:
    """(rep, v): the distinct values with the place where each first occurs."""
    return column.groupBy(F.col(value).alias("v")).agg(F.min(pos).alias("rep")).select("rep", "v")
