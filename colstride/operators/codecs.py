"""Compression of columns: logical transforms in window functions, and real pages through numpy kernels.

A column is cut into pages of consecutive positions; pages are encoded independently, so both ways
scale with the number of pages and a page is the unit of random access.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import uint64 as U
from ..sources.columns import numbered
from . import kernels as K
from .projection import project

#: Values of a page, and the formats by code; 1 .. 64 stand for static widths.
PAGE = 2048
CODES = {
    0: K.Uncompressed(),
    65: K.DynamicVbp(),
    66: K.GroupSimple(),
    67: K.Delta(K.DynamicVbp()),
    68: K.Delta(K.GroupSimple()),
    69: K.Reference(K.DynamicVbp()),
    70: K.Reference(K.GroupSimple()),
}
NAMES = {
    "uncompressed": K.Uncompressed(), "static_vbp": K.StaticVbp(), "vbp_padding": K.PaddedVbp(), "dynamic_vbp": K.DynamicVbp(),
    "k_wise_ns": K.NullSuppression(), "group_simple": K.GroupSimple(), "delta": K.Delta(), "for": K.Reference(), "rle": K.RunLength(),
}


def block_of(size: int, pos: str = "pos") -> Column:
    return F.expr(f"`{pos}` div {size}")


def delta_encode(column: DataFrame, block: int = 1024, step: int = 1) -> DataFrame:
    """(pos, v): difference to the value ``step`` before it in the same block; the first ones stay."""
    before = F.lag("v", step).over(W.partitionBy(block_of(block)).orderBy("pos"))
    return column.select("pos", (F.col("v") - F.coalesce(before, F.lit(0))).alias("v"))


def delta_decode(column: DataFrame, block: int = 1024, step: int = 1) -> DataFrame:
    lane = F.pmod(F.pmod(F.col("pos"), F.lit(block)), F.lit(step))
    w = W.partitionBy(block_of(block), lane).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return column.select("pos", F.sum("v").over(w).alias("v"))


def for_encode(column: DataFrame, block: int = 1024) -> DataFrame:
    """(pos, ref, v): difference to the least value of the block, which is ``ref``."""
    ref = F.min("v").over(W.partitionBy(block_of(block)))
    return column.select("pos", ref.alias("ref"), (F.col("v") - ref).alias("v"))


def for_decode(column: DataFrame) -> DataFrame:
    return column.select("pos", (F.col("v") + F.col("ref")).alias("v"))


def rle_encode(column: DataFrame, ranges: int = 65536) -> DataFrame:
    """(pos, v, length): runs of equal values, with the position where each starts.

    Runs are found in ranges of positions side by side; what crosses a seam is settled on one row per
    range, so no window sees the whole column.
    """
    rows = column.select("pos", "v", block_of(ranges).alias("r"))
    seams = rows.groupBy("r").agg(F.max_by("v", "pos").alias("last")).select((F.col("r") + 1).alias("r"), "last")
    w = W.partitionBy("r").orderBy("pos")
    before = F.coalesce(F.lag("v").over(w), F.when(F.row_number().over(w) == 1, F.col("last")))
    marked = rows.join(seams, "r", "left").withColumn("start", F.when(before.isNull() | (before != F.col("v")), F.col("pos")))
    last_start = marked.groupBy("r").agg(F.max("start").alias("s"))
    carry = last_start.select("r", F.last("s", ignorenulls=True).over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    own = F.max("start").over(w.rowsBetween(W.unboundedPreceding, 0))
    runs = marked.withColumn("own", own).join(carry, "r").withColumn("run", F.coalesce("own", "carry"))
    return runs.groupBy(F.col("run").alias("pos")).agg(F.first("v").alias("v"), F.count("*").alias("length"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(pos, v) again; every run brings its own positions."""
    return runs.select(F.explode(F.sequence("pos", F.col("pos") + F.col("length") - 1)).alias("pos"), "v")


def vbp_sizes(column: DataFrame, block: int) -> DataFrame:
    """(block, width, n, bits): what packing each block with its own width takes."""
    packed = column.groupBy(block_of(block).alias("block")).agg(U.bitwidth(F.bit_or("v")).alias("width"), F.count("*").alias("n"))
    return packed.withColumn("bits", F.col("width") * F.col("n"))


def k_wise_sizes(column: DataFrame, k: int = 2) -> DataFrame:
    """One row (n, bytes): bytes of the values without leading zero bytes, and a descriptor per k values."""
    return column.agg(F.count("*").alias("n"), (F.coalesce(F.sum(U.bytewidth(F.col("v"))), F.lit(0)) + F.ceil(F.count("*") / k)).alias("bytes"))


#: Pages that are Python objects at a time.
PAGES_HELD = 64


def _slices(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, PAGES_HELD):
            yield batch.slice(k, PAGES_HELD)


def _through(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``frame.mapInArrow(run, schema)``. Right behind another such step it runs in that one's worker, page by
    page: a chain of steps takes one Python process for each task, and no batch of pages lies between them."""
    source, before = (frame, None) if frame.is_cached else vars(frame).get("_steps", (frame, None))

    def both(batches):
        return run(before(batches))

    work = run if before is None else both
    out = source.mapInArrow(work, schema)
    out._steps = source, work
    return out


def _of_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """``pages`` with these columns; itself if it has no others."""
    return pages if pages.columns == list(columns) else pages.select(*columns)


def _pages(column: DataFrame, page: int, schema: str, work: Callable[[int, np.ndarray], tuple]) -> DataFrame:
    """A row of ``work`` for each page; tasks take many pages, one after the other."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        held: list[tuple[int, np.ndarray]] = []

        def rows(parts: list[tuple[int, np.ndarray]]):
            return work(parts[0][0], np.concatenate([v for _, v in parts]))

        for batch in batches:
            number, v = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
            edges = np.append(np.flatnonzero(np.diff(number, prepend=number[:1] - 1)), len(number)).tolist()
            out = []
            for a, b in zip(edges, edges[1:]):
                if held and held[0][0] != number[a]:
                    out.append(rows(held))
                    held = []
                held.append((int(number[a]), v[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(rows(held), types, strict=True)], names)

    dealt = column.select(block_of(page).alias("page"), F.col("v").cast("long").alias("v"), "pos").repartition("page").sortWithinPartitions("page", "pos")
    return _through(dealt.select("page", "v"), run, schema)


def encode(column: DataFrame, kernel, page: int = PAGE) -> DataFrame:
    """(page, n, data): a compressed column of consecutive positions."""
    return _pages(column, page, "page long, n long, data binary", lambda p, v: (p, len(v), kernel.encode(v)))


def decode(pages: DataFrame, kernel, page: int = PAGE) -> DataFrame:
    """(pos, v) again."""

    def run(batches):
        for batch in _slices(batches):
            for p, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = kernel.decode(data, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * page, p * page + n)), pa.array(values.astype(np.uint64).view(np.int64))], ["pos", "v"])

    return _through(_of_pages(pages, "page", "n", "data"), run, "pos long, v long")


def morph(pages: DataFrame, source, target, page: int = PAGE) -> DataFrame:
    """The same values in another format; the same format is the same frame. Pages stay where they are."""
    if source == target:
        return pages

    def run(batches):
        for batch in _slices(batches):
            _, ns, datas = (c.to_pylist() for c in batch.columns)
            again = [target.encode(source.decode(d, n)) for n, d in zip(ns, datas, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(again, pa.binary())], ["page", "n", "data"])

    return _through(_of_pages(pages, "page", "n", "data"), run, "page long, n long, data binary")


def read_at(pages: DataFrame, positions: DataFrame, kernel, page: int = PAGE) -> DataFrame:
    """(pos, v) at given positions: only pages that hold some are touched, and formats whose values have a
    known place (``at``) are read there, without decoding the page."""
    wanted = positions.groupBy(block_of(page).alias("page")).agg(F.collect_list("pos").alias("at"))

    def run(batches):
        for batch in _slices(batches):
            for p, n, data, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.array(at, dtype=np.int64)
                at = at[at < p * page + n]
                values = kernel.at(data, n, at - p * page) if hasattr(kernel, "at") else kernel.decode(data, n)[at - p * page]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values.astype(np.uint64).view(np.int64))], ["pos", "v"])

    return pages.join(wanted, "page").select("page", "n", "data", "at").mapInArrow(run, "pos long, v long")


def process_pages(pages: DataFrame, kernel, step: Callable[[object, np.ndarray], object], start: object, finish: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Feed decompressed pages to an operator core without a column in between: each task folds its pages
    with ``step`` from ``start`` and gives one row (state); ``finish`` combines these rows."""

    def run(batches):
        state = start
        for batch in _slices(batches):
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                state = step(state, kernel.decode(data, n))
        yield pa.RecordBatch.from_pylist([{"state": state}])

    return finish(_through(_of_pages(pages, *[c for c in ("page", "n", "data") if c in pages.columns]), run, schema))


def select_packed(pages: DataFrame, value: int, page: int = PAGE) -> DataFrame:
    """(pos) where a statically packed column equals ``value``, told from the packed pages.

    A page whose width is too small for the value is skipped by its first byte. In the others the bits of
    all values are compared with those of the value, so no value is put together.
    """
    width = max(1, value.bit_length())

    def run(batches):
        for batch in _slices(batches):
            for p, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data[0] < width or not n:
                    continue
                planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1), count=n * data[0], bitorder="little").reshape(n, data[0])
                pattern = np.array([value >> k & 1 for k in range(data[0])], dtype=np.uint8)
                at = np.flatnonzero((planes == pattern).all(1)) + p * page
                yield pa.RecordBatch.from_arrays([pa.array(at)], ["pos"])

    skipping = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int") >= width
    return pages.where(skipping).select("page", "n", "data").mapInArrow(run, "pos long")


def rle_select(runs: DataFrame, condition: Column) -> DataFrame:
    """(pos) of values that meet a condition on ``v``: runs are tested, only matching ones are unrolled."""
    return rle_decode(runs.where(condition)).select("pos")


def rle_sum(runs: DataFrame) -> DataFrame:
    """One row (v): the sum of a run-length column, one product per run."""
    return runs.agg(U.to_bits(U.sum_wrapped(U.mul(U.from_bits(F.col("v")), F.col("length")))).alias("v"))


def pack_positions(positions: DataFrame, kernel=NAMES["delta"], page: int = PAGE) -> DataFrame:
    """(page, n, data) of a position list in ascending order, compressed."""
    return encode(numbered(positions.select(F.col("pos").alias("v")), "v"), kernel, page)


def unpack_positions(pages: DataFrame, kernel=NAMES["delta"], page: int = PAGE) -> DataFrame:
    """(pos) of a packed position list, page by page: what any operator takes."""
    return decode(pages, kernel, page).select(F.col("v").alias("pos"))


def project_packed(data: DataFrame, positions: DataFrame, kernel=NAMES["delta"], page: int = PAGE) -> DataFrame:
    """(pos, v): the values at the positions of a packed list, in its order."""
    return project(data, decode(positions, kernel, page).select(F.col("pos").alias("n"), F.col("v").alias("pos")), order="n")
