"""Set operations on lists of positions (sorted and free of repeats; order them by ``pos`` to see them so)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def intersect_sorted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions in both lists."""
    return left.select("pos").join(right.select("pos"), "pos", "left_semi")


def merge_sorted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions in either list, once."""
    return left.select("pos").union(right.select("pos")).distinct()
