"""Sums: 0 over no rows, modulo 2 ** 64 for whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import uint64 as U
from ..functions.primitives import is_pattern


def agg_sum(column: DataFrame, value: str = "v") -> DataFrame:
    """One row (v): the sum of a column.

    Longs are patterns and so is their sum, which wraps; exact unsigned decimals give one of these. Other
    types sum as Spark does.
    """
    kind = column.schema[value].dataType
    if is_pattern(kind):
        return column.agg(*U.limb_sums(F.col(value))).select(U.of_limbs().alias("v"))
    total = U.sum_wrapped(F.col(value)) if isinstance(kind, T.DecimalType) else F.coalesce(F.sum(F.col(value)), F.lit(0))
    return column.agg(total.alias("v"))


def agg_sum_grouped(ids: DataFrame, data: DataFrame, n_groups: int, value: str = "v", pos: str = "pos", check: bool = True) -> DataFrame:
    """(gid, v) for the groups 0 .. n_groups - 1; a group without rows has 0, and sums wrap. Raises when lengths differ."""
    if check and ids.count() != data.count():
        raise ValueError("both inputs must have the same length")
    rows = ids.select("pos", "gid").join(data.select(F.col(pos).alias("pos"), F.col(value).cast("long").alias("_v")), "pos")
    sums = rows.groupBy("gid").agg(*U.limb_sums(F.col("_v"))).select("gid", U.of_limbs().alias("_s"))
    every = ids.sparkSession.range(n_groups).select(F.col("id").alias("gid"))
    return every.join(sums, "gid", "left").select("gid", F.coalesce("_s", F.lit(0).cast("long")).alias("v"))
