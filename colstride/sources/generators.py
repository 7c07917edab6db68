"""Seeded columns: the same arguments give the same rows in every run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uint64 as U


def draw(seed: int, k: int = 0) -> Column:
    """A uniform number in [0, 1) for each ``pos``, the same whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("pos")), 12) / F.lit(float(1 << 52))


def uniform(lo: int, hi: int, seed: int, k: int = 0) -> Column:
    """Whole numbers from lo to hi, ends included."""
    return (F.lit(lo) + F.floor(draw(seed, k) * (hi - lo + 1))).cast("long")


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"))


def sorted_unique(spark: SparkSession, n: int, start: int = 0, step: int = 1) -> DataFrame:
    """start, start + step, ... (all alike for step 0)."""
    return rows(spark, n).withColumn("v", F.lit(start).cast("long") + F.col("pos") * step)


def sorted_unique_extraction(spark: SparkSession, n: int, population: int, seed: int) -> DataFrame:
    """n of the numbers below ``population``, drawn without replacement, ascending."""
    if n > population:
        raise ValueError("more values than the population has")
    # The rank of each draw over ranges, so that no task takes all of them.
    return _renumbered(_shuffled(rows(spark, population), seed).where(F.col("rank") < n).select(F.col("pos").alias("v")), "v")


def _renumbered(df: DataFrame, *order: str) -> DataFrame:
    from .columns import numbered

    return numbered(df, *order).select("pos", "v")


def finished(df: DataFrame, is_sorted: bool) -> DataFrame:
    return _renumbered(df.select("v"), "v") if is_sorted else df.select("pos", "v")


def with_distribution(spark: SparkSession, n: int, value: Column, is_sorted: bool = False) -> DataFrame:
    """A column of ``value``, an expression over ``pos`` such as ``uniform`` or ``two_values``."""
    return finished(rows(spark, n).withColumn("v", value.cast("long")), is_sorted)


def two_values(v0: int, v1: int, p1: float, seed: int) -> Column:
    """v1 with probability p1, else v0."""
    return F.when(draw(seed, 1) < p1, F.lit(v1)).otherwise(F.lit(v0))


def two_distributions(d0: Column, d1: Column, p1: float, seed: int) -> Column:
    """A draw of d1 with probability p1, else of d0."""
    return F.when(draw(seed, 2) < p1, d1).otherwise(d0)


def rounded_real(spark: SparkSession, n: int, sampler: str, args: Sequence[float], lo: int, hi: int, seed: int, is_sorted: bool = False) -> DataFrame:
    """Draws of a numpy sampler ("normal", "exponential", ...) rounded to whole numbers; those outside
    lo .. hi are drawn again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(0).to_numpy()
            out = np.empty(len(pos), dtype=np.int64)
            # A stream for each row group of 1024 positions, wherever it runs.
            for start in np.unique(pos >> 10):
                own = (pos >> 10) == start
                rng = np.random.default_rng([seed, int(start)])
                values = np.full(1024, lo - 1, dtype=np.int64)
                while (bad := (values < lo) | (values > hi)).any():
                    values[bad] = np.rint(getattr(rng, sampler)(*args, size=int(bad.sum()))).astype(np.int64)
                out[own] = values[pos[own] & 1023]
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(out)], ["pos", "v"])

    return finished(rows(spark, n).mapInArrow(run, "pos long, v long"), is_sorted)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(histogram, width, weight) from a file of 64-byte records, one byte for each bit width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                values = np.frombuffer(content, dtype=np.uint8)
                k = np.arange(len(values))
                yield pa.RecordBatch.from_arrays([pa.array(k // 64), pa.array(k % 64 + 1), pa.array(values.astype(np.int64))], ["histogram", "width", "weight"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "histogram long, width long, weight long")


def histogram_counts(n: int, weights: Sequence[int]) -> list[int]:
    """Values of each width: the whole part of each share of n, and one more for the largest fractions
    (the first among equal ones). Widths without weight get none, and those with little may."""
    total = sum(weights)
    counts = [n * w // total for w in weights]
    rest = sorted((k for k, w in enumerate(weights) if w), key=lambda k: -(n * weights[k] % total))
    for k in rest[: n - sum(counts)]:
        counts[k] += 1
    return counts


def with_bitwidths(spark: SparkSession, n: int, weights: Sequence[int], seed: int, is_sorted: bool = False, exact: bool = True) -> DataFrame:
    """Values whose bit widths follow 64 weights; uniform within a width. Those of 64 bits come as patterns.

    ``exact`` (and every sorted column) meets the counts; else widths are drawn with these chances.
    """
    counts = histogram_counts(n, weights)
    ends, total = [], 0
    for c in counts:
        total += c
        ends.append(total)
    # Widths by a shuffled rank (exact) or by a draw: the same comparison against running sums.
    place = F.floor(draw(seed, 3) * n).cast("long")
    base = rows(spark, n)
    if exact or is_sorted:
        base = _shuffled(base, seed)
        place = F.col("rank")
    width = F.lit(len(counts))
    for w in range(len(counts), 0, -1):
        width = F.when(place < ends[w - 1], F.lit(w)).otherwise(width)
    base = base.withColumn("w", width)
    # The top bit, and bits of a hash below it; width 1 has both of its values.
    shift = lambda name, value, by: F.call_function(name, F.lit(value).cast("long"), by.cast("int"))
    top = F.when(F.col("w") == 1, F.lit(0).cast("long")).otherwise(shift("shiftleft", 1, F.col("w") - 1))
    below = F.when(F.col("w") == 1, F.lit(1).cast("long")).otherwise(shift("shiftrightunsigned", -1, 65 - F.col("w")))
    value = top.bitwiseOR(F.xxhash64(F.lit(seed), F.lit(4), "pos").bitwiseAND(below))
    made = base.withColumn("v", value)
    return _renumbered(made.select(U.ordered(F.col("v")).alias("o"), "v"), "o") if is_sorted else finished(made, False)


def _shuffled(base: DataFrame, seed: int) -> DataFrame:
    from .columns import numbered

    ranked = numbered(base.select(F.col("pos").alias("p"), F.xxhash64(F.lit(seed), F.lit(5), "pos").alias("d")), "d", "p")
    return ranked.select(F.col("p").alias("pos"), F.col("pos").alias("rank"))


def exact_number(spark: SparkSession, n: int, matches: int, value: int, other: int, seed: int, is_sorted: bool = False) -> DataFrame:
    """``value`` exactly ``matches`` times at random places, ``other`` elsewhere."""
    if matches > n:
        raise ValueError("more matches than values")
    if value == other:
        raise ValueError("the two values must differ")
    base = _shuffled(rows(spark, n), seed)
    return finished(base.withColumn("v", F.when(F.col("rank") < matches, F.lit(value)).otherwise(F.lit(other)).cast("long")), is_sorted)


def with_outliers(
    spark: SparkSession, n: int, main: tuple[int, int], selected_share: float, outliers: tuple[int, int], outlier_share: float, seed: int, is_sorted: bool = False
) -> DataFrame:
    """Uniform main values, a share of outliers above them, and a share equal to the least main value."""
    both = 0 < outlier_share < 1
    rules = {
        "the main range holds at least two values": main[0] < main[1],
        "the outlier range isn't empty": not both or outliers[0] <= outliers[1],
        "outliers lie above the main range": not both or main[1] < outliers[0],
        "the selected share is a probability": 0 <= selected_share <= 1,
        "the outlier share is a probability": 0 <= outlier_share <= 1,
        "both shares fit together": selected_share + outlier_share <= 1,
    }
    if broken := [rule for rule, holds in rules.items() if not holds]:
        raise ValueError("must hold: " + "; ".join(broken))
    chosen = selected_share / (1 - outlier_share) if outlier_share < 1 else 0.0
    value = (
        F.when(draw(seed, 6) < outlier_share, uniform(*outliers, seed, 7))
        .when(draw(seed, 8) < chosen, F.lit(main[0]))
        .otherwise(uniform(main[0] + 1, main[1], seed, 9))
    )
    return with_distribution(spark, n, value, is_sorted)


