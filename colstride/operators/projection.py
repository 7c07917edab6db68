"""Projection: the values at given positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(data: DataFrame, positions: DataFrame, value: str = "v", pos: str = "pos", order: str | None = None, strict: bool = False) -> DataFrame:
    """Gather ``data[pos]`` for each row of ``positions``.

    With ``order``, a column of ``positions`` that numbers its rows, the result is (pos, v) with that
    number as the new position: repeats and any order are kept. Without, the positions themselves stay.
    Positions out of range are left out; ``strict`` raises for them. A selection on the same frame should be
    written as ``where`` on it instead: then nothing is joined.
    """
    number = order or "pos"
    wanted = positions.select(F.col(number).alias("_n"), F.col("pos").alias("_at"))
    found = data.select(F.col(pos).alias("_at"), F.col(value).alias("v"))
    joined = wanted.join(found, "_at", "left" if strict else "inner")
    if strict:
        joined = joined.withColumn("v", F.when(F.col("v").isNull(), F.raise_error(F.lit("position out of range"))).otherwise(F.col("v")))
    return joined.select(F.col("_n").alias("pos"), "v")
