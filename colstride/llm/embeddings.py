"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 (1 - c). Rotated and split into blocks, a
pair must stay within its proportional share of that distance in at least one block, so a range join in
each low-dimensional block finds every pair; full vectors then decide. For the range join of a block the
vectors are dealt to a grid over its first coordinates and laid, cell after cell, into pages of bounded
size. Pages whose ranges come close enough are held against each other, in them strips whose ranges do.
Pages meet where they are read: nothing is copied for it, so disk grows with the table and not with the
pairs. A pair counts in the first block that finds it, and tasks return counts and a spanning forest,
never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import _graph
from . import _shared as S

#: Coordinates of a block, and those of them that the grid divides.
BLOCK, GRID = 16, 4
#: Rotated coordinates are rounded to multiples of 2 ** -20, so that every task sees the same distances.
SCALE = float(1 << 20)
#: Bounds of the rows of a page, a 24th of the table between them, and of the bytes of its vectors.
LEAST_TILE, MOST_TILE, PAGE_BYTES = 512, 4096, 1 << 20
#: Rows of a strip of a page.
STRIP = 256
#: What single precision may add to half a squared distance between parts of unit vectors.
SLACK = 1e-5
#: Vectors and bytes that the grid is fitted to at most; it steers the cost, never the result.
SAMPLE, SAMPLE_BYTES = 4096, 1 << 22
#: Bytes of vectors whose blocks are joined in one go; larger tables take block after block.
AT_ONCE = 1 << 26
#: Ids that a task sums up before it hands them on.
MOST_HELD = 200_000
#: Seed of the rotation.
SEED = 20


@cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, dim)) for k in range(0, dim, BLOCK)]


def limits(dim: int, cosine: float) -> list[float]:
    """Largest squared distance of a block, in rounded units: its share of the budget and the rounding."""
    whole = 2 * (1 - cosine)
    return [float(np.ceil((np.sqrt(whole * (b.stop - b.start) / dim) * SCALE + 2 * np.sqrt(b.stop - b.start)) ** 2)) for b in blocks_of(dim)]


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is divided out first."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def rotated(unit: np.ndarray) -> np.ndarray:
    """Rounded rotated coordinates, summed in a fixed order: a row's result doesn't depend on the others."""
    turn = rotation(unit.shape[1])
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * turn[k]
    return np.rint(out * SCALE)


def packed_vectors(lists: pa.ListArray, kind: str) -> list[bytes | None]:
    """The bytes of each vector that can be compared at all."""
    flat = lists.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy().astype(np.int64)
    odd, some = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (~np.isfinite(flat), flat != 0))
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(odd) == 0) & (np.diff(some) > 0)
    flat = flat.astype(kind)
    return [flat[a:b].tobytes() if o else None for a, b, o in zip(ends[:-1].tolist(), ends[1:].tolist(), ok.tolist(), strict=True)]


class Layout:
    """Where the vectors of one length lie in the range join of a block: grid and order of the cells, fitted
    to a sample, which the parts of the table divide evenly."""

    def __init__(self, y: np.ndarray, draws: np.ndarray, n: float, page_rows: int):
        cells = max(1, round((n / STRIP) ** (1 / GRID)))
        self.inner = np.quantile(y[:, :GRID], np.arange(1, cells) / cells, axis=0)
        parts = max(1, int(n // page_rows))
        self.bounds = np.quantile(self.keys(y, draws), np.arange(1, parts) / parts)

    def keys(self, y: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Numbers of the cells, and ``draws`` as the order within them: neighbours in the last
        coordinates follow each other, up and down in turn."""
        at = np.zeros(len(y))
        for k in range(self.inner.shape[1]):
            cells = len(self.inner) + 1
            step = np.searchsorted(self.inner[:, k], y[:, k])
            at = at * cells + np.where(at % 2 == 0, step, cells - 1 - step)
        return at + draws

    def parts(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys)


def fitted(sample: list[tuple[int, bytes]], kind: str, n: int, page_rows: int) -> dict[tuple[int, int], Layout]:
    """Layouts by length and block; ``n`` rows in all."""
    by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row, raw in sample:
        x = np.frombuffer(raw, dtype=kind)
        by_dim.setdefault(len(x), []).append((row, x))
    out = {}
    for dim, own in by_dim.items():
        y = rotated(units(np.stack([x for _, x in own])))
        draws = draw(np.array([row for row, _ in own]))
        for b, part in enumerate(blocks_of(dim)):
            out[dim, b] = Layout(y[:, part], draws, n * len(own) / len(sample), page_rows)
    return out


def draw(rows: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for row numbers."""
    mixed = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(12)) / float(1 << 52)


def deal(members: DataFrame, kind: str, layouts: dict[tuple[int, int], Layout], blocks: range) -> DataFrame:
    """(block, dim, part, key, rep, weight, y, raw): each vector in each of ``blocks`` that it has; y are its
    coordinates there."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = batch.column(0).to_numpy()
            raws = [np.frombuffer(v, dtype=kind) for v in batch.column(3).to_pylist()]
            sizes = np.array([len(v) for v in raws])
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                whole, draws = rotated(units(np.stack([raws[i] for i in own]))), draw(rows[own])
                kept = pa.array(own)
                for b in blocks:
                    if b >= len(blocks_of(dim)):
                        break
                    y, layout = whole[:, blocks_of(dim)[b]], layouts.get((dim, b))
                    keys = layout.keys(y, draws) if layout else draws
                    parts = layout.parts(keys) if layout else np.zeros(len(own))
                    same = np.full(len(own), 1, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(same * b), pa.array(same * dim), pa.array(parts.astype(np.int32)), pa.array(keys), batch.column(1).take(kept), batch.column(2).take(kept),
                         pa.array([v.tobytes() for v in y.astype("<i4")], pa.binary()), batch.column(3).take(kept)],
                        ["block", "dim", "part", "key", "rep", "weight", "y", "raw"])

    return members.select("row", "rep", "weight", "raw").mapInArrow(run, "block int, dim int, part int, key double, rep long, weight long, y binary, raw binary")


#: Columns of a page besides the range of its first coordinates.
PAGE = "page string, block int, dim int, most double, ids binary, weights binary, ys binary, raws binary"


def paged(dealt: DataFrame, cosine: float, page_rows: int) -> DataFrame:
    """Pages of the rows of each part, with the range (lo, hi) of their coordinates on the grid."""
    ranges = [f"{side}{k}" for side in ("lo", "hi") for k in range(GRID)]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place, number = None, 0

        def page() -> pa.RecordBatch:
            block, dim, part = place
            ids, weights = (np.concatenate([h.column(k).to_numpy() for h in held]).astype("<i8") for k in (4, 5))
            ys, raws = (b"".join(v for h in held for v in h.column(k).to_pylist()) for k in (6, 7))
            y = np.frombuffer(ys, dtype="<i4").reshape(len(ids), -1)[:, :GRID]
            y = np.hstack([y, np.zeros((len(y), GRID - y.shape[1]))])
            values = [f"{part:010}:{number:010}", block, dim, limits(dim, cosine)[block], ids.tobytes(), weights.tobytes(), ys, raws, *y.min(0).tolist(), *y.max(0).tolist()]
            types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4, *[pa.float64()] * (2 * GRID)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in PAGE.split(", ")] + ranges)

        for batch in batches_:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                here = tuple(places[a].tolist())
                if held and here != place:
                    yield page()
                    held, number = [], 0
                place = here
                while a < b:
                    take = min(b - a, page_rows - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, take))
                    a += take
                    if sum(h.num_rows for h in held) == page_rows:
                        yield page()
                        held, number = [], number + 1
        if held:
            yield page()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = PAGE + "".join(f", {name} double" for name in ranges)
    return dealt.repartition(n, "block", "dim", "part").sortWithinPartitions("block", "dim", "part", "key").mapInArrow(run, schema)


class Page:
    """A page in a task; what only linked rows need is worked out for those."""

    def __init__(self, dim: int, kind: str, ids: bytes, weights: bytes, ys: bytes, raws: bytes):
        self.ids, self.weights = np.frombuffer(ids, dtype="<i8"), np.frombuffer(weights, dtype="<i8")
        self.raw = np.frombuffer(raws, dtype=kind).reshape(-1, dim)
        y = np.frombuffer(ys, dtype="<i4").reshape(len(self.ids), -1)
        starts = np.arange(0, len(y), STRIP)
        self.lo, self.hi = np.minimum.reduceat(y, starts).astype(float), np.maximum.reduceat(y, starts).astype(float)
        # Products of these are minus half the squared distance.
        x = y / SCALE
        half, one = (x * x).sum(1, keepdims=True) / -2, np.ones((len(x), 1))
        self.left, self.right = np.hstack([x, half, one]).astype(np.float32), np.hstack([x, one, half]).astype(np.float32)
        self.done = np.zeros(len(y), dtype=bool)
        self.unit = self.turned = None

    def exact(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and rotated coordinates."""
        if self.unit is None:
            self.unit, self.turned = np.zeros(self.raw.shape), np.zeros(self.raw.shape)
        new = rows[~self.done[rows]]
        if len(new):
            self.unit[new] = units(self.raw[new])
            self.turned[new] = rotated(self.unit[new])
            self.done[new] = True
        return self.unit[rows], self.turned[rows]


def linked(a: Page, b: Page, alone: bool, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, links between them), where there are any that no earlier block finds; a page
    that is held against itself gives each pair once."""
    dim = a.raw.shape[1]
    parts, most = blocks_of(dim), limits(dim, cosine)
    floor = np.float32(-most[block] / SCALE**2 / 2 - SLACK)
    for k, start in enumerate(range(0, len(a.ids), STRIP)):
        gap = np.maximum(0, np.maximum(b.lo - a.hi[k], a.lo[k] - b.hi))
        near = np.flatnonzero((gap * gap).sum(1) <= most[block])
        if alone:
            near = near[near >= k]
        if not len(near):
            continue
        rows = np.arange(start, min(start + STRIP, len(a.ids)))
        others = (near[:, None] * STRIP + np.arange(STRIP)[None, :]).ravel()
        others = others[others < len(b.ids)]
        close = a.left[rows] @ b.right[others].T
        if alone:  # the strip itself comes first
            close[:, : len(rows)][np.tril_indices(len(rows))] = -np.inf
        if close.max() < floor:
            continue
        hit = close >= floor
        some, theirs = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        hit, rows, others = hit[np.ix_(some, theirs)], rows[some], others[theirs]
        (unit_a, turned_a), (unit_b, turned_b) = a.exact(rows), b.exact(others)

        def within(c: int) -> np.ndarray:
            # Whole numbers below 2 ** 53: exact.
            x, y = turned_a[:, parts[c]], turned_b[:, parts[c]]
            return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= most[c]

        hit &= within(block)
        for c in range(block):
            hit &= ~within(c)
        hit &= a.ids[rows][:, None] != b.ids[others][None, :]
        hit &= unit_a @ unit_b.T >= cosine
        if hit.any():
            yield rows, others, hit


class Found:
    """Links of a task: their number by id, and a spanning forest."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def count(self, ids: np.ndarray, more: np.ndarray) -> None:
        for i, n in zip(ids.tolist(), more.tolist(), strict=True):
            if n:
                self.counts[i] = self.counts.get(i, 0) + n

    def find(self, x: int) -> int:
        root = self.root
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def batch(self) -> pa.RecordBatch:
        """(kind, a, b): kind 0 gives b links to a, kind 1 a link of the forest."""
        kinds = np.repeat(np.array([0, 1], dtype=np.int32), [len(self.counts), len(self.edges)])
        pairs = np.array([*self.counts.items(), *self.edges], dtype=np.int64).reshape(-1, 2)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["kind", "a", "b"])


def compare(found: Found, a: Page, b: Page, alone: bool, block: int, cosine: float) -> None:
    """Add the links between two pages to ``found``."""
    links_a, links_b = np.zeros(len(a.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
    for rows, others, hit in linked(a, b, alone, block, cosine):
        links_a[rows] += hit @ b.weights[others]
        links_b[others] += a.weights[rows] @ hit
        # Only what joins components: rows are told apart by the roots of their partners.
        label = np.array([found.find(x) for x in b.ids[others].tolist()])
        for i, row in zip(a.ids[rows].tolist(), hit, strict=True):
            roots, first = np.unique(label[row], return_index=True)
            own = found.find(i)
            if (roots != own).any():
                for j in b.ids[others[np.flatnonzero(row)[first]]].tolist():
                    found.join(i, j)
                label[np.isin(label, [own, *roots.tolist()])] = found.find(i)
    found.count(a.ids, links_a)
    found.count(b.ids, links_b)


def meeting(pages: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(kind, a, b) of all pages whose ranges come within reach of each other."""
    left, right = (pages.select(*[F.col(c).alias(f"{side}_{c}") for c in pages.columns]) for side in "ab")
    on = (F.col("a_block") == F.col("b_block")) & (F.col("a_dim") == F.col("b_dim")) & (F.col("a_page") <= F.col("b_page"))
    reach = F.lit(0.0)
    for k in range(GRID):
        gap = F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"))
        reach = reach + gap * gap
    # Partitions of pages meet pairwise where they are read, without a shuffle.
    pairs = left.join(right.hint("shuffle_replicate_nl"), on & (reach <= F.col("a_most")))
    sides = [[f"{side}_{c}" for c in ("ids", "weights", "ys", "raws")] for side in "ab"]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known, a = Found(), None, None
        for batch in batches_:
            for r in range(batch.num_rows):
                block, dim, own, other = (batch.column(k)[r].as_py() for k in range(4))
                if known != (block, dim, own):
                    known, a = (block, dim, own), Page(dim, kind, *(batch.column(k)[r].as_py() for k in range(4, 8)))
                b = a if own == other else Page(dim, kind, *(batch.column(k)[r].as_py() for k in range(8, 12)))
                compare(found, a, b, own == other, block, cosine)
                if len(found.counts) > MOST_HELD:
                    yield found.batch()
        if found.counts:
            yield found.batch()

    return pairs.select("a_block", "a_dim", "a_page", "b_page", *sides[0], *sides[1]).mapInArrow(run, "kind int, a long, b long")


def _links(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(kind, a, b) of all vectors, block after block."""
    spark = members.sparkSession
    width = int(kind[-1])
    n, longest, total = members.agg(F.count("*"), F.max(F.length("raw")), F.sum(F.length("raw"))).first()
    blocks = len(blocks_of((longest or 0) // width))
    page_rows = max(1, min(MOST_TILE, max(LEAST_TILE, n // 24), PAGE_BYTES // (longest or 1)))
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (longest or 1)))
    share = -(-(wanted << 20) // max(n, 1))
    sample = members.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < share).select("row", "raw").limit(2 * wanted)
    layouts = fitted([tuple(r) for r in sample.collect()], kind, n, page_rows)
    step = max(1, AT_ONCE // (total or 1))
    found = spark.createDataFrame([], "kind int, a long, b long")
    for k in range(0, blocks, step):
        with S.scratch(spark) as keep:
            pages = S.stored(paged(deal(members, kind, layouts, range(k, min(k + step, blocks))), cosine, page_rows), "pages")
            # A row is two pages: few of them at a time.
            with S.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4", spark__sql__parquet__columnarReaderBatchSize="16", spark__sql__files__maxPartitionBytes="64m"):
                found = found.union(keep(meeting(pages, kind, cosine), "links"))
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    All pairs with cosine >= ``cosine`` (above 0, in double precision) are linked and no others.
    component_id is the smallest vec_id that links lead to, and kept marks it. Null and empty vectors,
    all-zero ones and those with null or non-finite components link with nothing, and neither do vectors
    of different lengths; a row with a null id has a null component and is kept; rows that share an id
    aren't linked with each other and are taken as one; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.select(f"`{embedding}`").schema[0].dataType.elementType, FloatType)
    kind, wide = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    base = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast(wide).alias("embedding"))

    def packed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            raws = packed_vectors(batch.column(1), kind)
            marks = [hashlib.blake2b(raw or b"", digest_size=16).digest() for raw in raws]
            halves = [pa.array([int.from_bytes(m[k : k + 8], "little", signed=True) for m in marks], pa.int64()) for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *halves, pa.array(raws, pa.binary())], ["vec_id", "fp_a", "fp_b", "raw"])

    with S.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"), S.scratch(spark) as keep:
        with S.scratch(spark) as outlive:
            rows = base.mapInArrow(packed, "vec_id long, fp_a long, fp_b long, raw binary").withColumn("row", F.monotonically_increasing_id())
            rows = S.stored(rows, "vectors")
            ids = keep(rows.select("vec_id", "fp_a", "fp_b", F.col("raw").isNotNull().alias("usable")), "ids")
            # Equal vectors are compared once; each counts for all of them.
            reps = rows.where("raw IS NOT NULL AND vec_id IS NOT NULL").groupBy("fp_a", "fp_b").agg(
                F.min(F.struct("vec_id", "row")).alias("first"), F.countDistinct("vec_id").alias("weight"))
            reps = keep(reps.select("fp_a", "fp_b", F.col("first.vec_id").alias("rep"), F.col("first.row").alias("row"), "weight"), "reps")
            members = outlive(rows.select("row", "raw").join(reps.select("row", "rep", "weight"), "row"), "members")
        found = keep(_links(members, kind, cosine), "links")
        groups = keep(_graph.components(found.where("kind = 1").select("a", "b")), "groups")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("found"))
    totals = reps.join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("id"), "left")
    totals = totals.select("fp_a", "fp_b", F.lit(True).alias("usable"), (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("total"), F.coalesce("component", "rep").alias("group"))
    whole = ids.join(totals, ["fp_a", "fp_b", "usable"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("group", "vec_id"))
    whole = whole.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("total", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
