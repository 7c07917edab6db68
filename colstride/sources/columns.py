"""Frames of one column: ``pos`` is the 0-based row number, ``v`` the value."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("v", T.LongType(), False)])


def from_values(spark: SparkSession, values: Sequence[int], most: int = 400) -> DataFrame:
    """A small literal column; raises for more than ``most`` values."""
    if len(values) > most:
        raise ValueError(f"{len(values)} values; literal columns hold {most} at most")
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], SCHEMA)


def from_parquet(spark: SparkSession, path: str, **columns: str | Column) -> DataFrame:
    """A table with its row numbers as ``pos``: ``from_parquet(spark, p, v="l_quantity")``.

    Row numbers restart in each file, so for tables of several files those of earlier files (by name)
    are added: one small aggregate over file metadata, joined by file.
    """
    table = spark.read.parquet(path)
    wanted = [(c if isinstance(c, Column) else F.col(c)).alias(name) for name, c in columns.items()] or [F.col("*")]
    files = table.inputFiles()
    if len(files) <= 1:
        return table.select(F.col("_metadata.row_index").alias("pos"), *wanted)
    tagged = table.select(F.col("_metadata.row_index").alias("_row"), F.col("_metadata.file_path").alias("_file"), *wanted)
    sizes = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").count()
    # One row per file.
    start = F.coalesce(F.sum("count").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", start.alias("_start"))
    return tagged.join(starts, "_file").select((F.col("_start") + F.col("_row")).alias("pos"), *[F.col(f"`{c}`") for c in tagged.columns if c not in ("_row", "_file")])


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with dense positions ``pos`` in the given order; the first column must be numeric.

    Rows are cut into ranges at approximate quantiles of the first column and numbered within each;
    a range starts where those before it end. Only one row per range is ordered in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order[0], [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    range_of = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda k, c: k + (F.col(order[0]) >= c).cast("int")) if cuts else F.lit(0)
    dealt = df.withColumn("_range", range_of)
    before = F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_range").count().select("_range", before.alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range")  # at most a row per shuffle partition
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_inside")).alias("pos"))


def store_binary(column: DataFrame, path: str, most: int = 100_000_000) -> None:
    """The raw layout on the driver's file system: count and bytes as unsigned 64-bit numbers, then values.

    One file in row order is the layout's nature, so it is for small columns: more than ``most`` values
    are refused. Tasks pack the values; the driver takes their blocks in turn and writes them.
    """
    n = column.count()
    if n > most:
        raise ValueError(f"{n} values; one raw file holds {most} at most")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype("<i8").tobytes()], pa.binary())], ["data"])

    with open(path, "wb") as f:
        f.write(struct.pack("<QQ", n, 8 * n))
        for row in column.orderBy("pos").select(F.col("v").cast("long")).mapInArrow(pack, "data binary").toLocalIterator(prefetchPartitions=True):
            f.write(row.data)


def load_binary(spark: SparkSession, path: str) -> DataFrame:
    """Read files of the raw layout; raises on a short file. Values from 2 ** 63 on come as patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if len(content) < 16:
                    raise ValueError("file too short for a header")
                n, size = struct.unpack_from("<QQ", content)
                if size != 8 * n or len(content) < 16 + size:
                    raise ValueError("file shorter than its header says")
                values = np.frombuffer(content, dtype="<u8", count=n, offset=16).view(np.int64)
                for k in range(0, n, 1 << 20):
                    part = values[k : k + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), pa.array(part)], ["pos", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pos long, v long")


def ensure_cached(df: DataFrame, name: str, cache: dict[str, DataFrame]) -> DataFrame:
    """The column cached under ``name``, cached now if it wasn't."""
    if name not in cache:
        cache[name] = df.cache()
    return cache[name]


def clear_cache(cache: dict[str, DataFrame]) -> None:
    for df in cache.values():
        df.unpersist()
    cache.clear()


def printed(columns: Sequence[DataFrame], base: str = "decimal", titles: Sequence[str] | None = None, most: int = 1000) -> str:
    """Up to five columns side by side in decimal, hexadecimal or binary; shorter ones end in (end)."""
    if not 1 <= len(columns) <= 5:
        raise ValueError("one to five columns are printed")
    form = {"decimal": str, "hexadecimal": lambda v: f"{v % (1 << 64):016x}", "binary": lambda v: f"{v % (1 << 64):064b}"}[base]
    lists = [[form(r.v) for r in c.orderBy("pos").limit(most).collect()] for c in columns]
    heads = list(titles or [f"column {k}" for k in range(len(columns))])
    height = max(map(len, lists)) + 1
    rows = [heads] + [[x[i] if i < len(x) else "(end)" if i == len(x) else "" for x in lists] for i in range(height)]
    widths = [max(len(r[k]) for r in rows) for k in range(len(columns))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, widths, strict=True)) for r in rows)


def zipped(columns: dict[str, DataFrame]) -> DataFrame:
    """Columns of equal length as one frame; raises without any, or when lengths differ."""
    if not columns:
        raise ValueError("no columns")
    lengths = {name: c.count() for name, c in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"lengths differ: {lengths}")
    out = None
    for name, c in columns.items():
        c = c.select("pos", F.col("v").alias(name))
        out = c if out is None else out.join(c, "pos")
    return out


def write_csv(columns: dict[str, DataFrame], path: str, sep: str = ",") -> None:
    """Columns of equal length as CSV with a header, in row order."""
    zipped(columns).orderBy("pos").drop("pos").write.csv(path, sep=sep, header=True, mode="overwrite")
