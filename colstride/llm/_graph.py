"""Connected components of links that live in a table, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): the smallest id that links lead to.

    Alternating large and small stars: every node hands its larger neighbours to its smallest one, then
    all its smaller ones, until only stars around the smallest ids are left; the number of rounds grows
    with the logarithm of the size. Each round is written to the shared folder. Neighbours of a node
    with very many never meet in one task (``join_hot``).
    """
    now = S.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = both.groupBy("u").agg(
            F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("parents"), F.count_if(F.col("v") > F.col("u")).alias("children"))
        nodes = S.stored(nodes, "nodes")
        # Stars: every node has one parent at most, and parents have none.
        if nodes.where("parents > 1 OR parents > 0 AND children > 0").isEmpty():
            break
        hot = S.hot_keys(nodes, "u", "n")
        large = S.join_hot(both.where("v > u"), nodes.select("u", "m"), "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = S.join_hot(large, small, "u", hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = S.stored(down.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
