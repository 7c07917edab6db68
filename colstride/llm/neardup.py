"""Near-duplicate documents with SetSketch registers: exponentially spaced truncated minima, banded for
candidates, compared by joint likelihood, and confirmed on the full shingle sets.

1. Every text becomes its set of word shingles (128-bit hashes), a 128-bit fingerprint of the set, and
   registers. Equal sets collapse to their smallest document.
2. Registers in bands give buckets. The member that meets most others becomes the hub of each of its
   buckets; all members are tested against their hubs, and links give components.
3. In a bucket that still holds several components, members of different ones are compared in tiles
   of bounded size: registers first, then full sets for those that pass. No pair inside one component
   is looked at, since it could change nothing, and tiles return a spanning forest, not all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _graph
from . import _shared as S
from ._text import Segments, batches, mix
from ._tiles import tiled

#: Registers of a sketch; bands and registers in each, of the first of them. At similarity 0.85 a pair
#: shares no band with probability (1 - 0.85 ** 5) ** 24 = 8e-7.
REGISTERS, BANDS, ROWS = 240, 24, 5
#: Base, rate and limit of the registers: the published settings for 16 bits.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Pairs whose likelihood peaks below this similarity aren't confirmed: over five standard deviations
#: under the link threshold of 0.85.
MARGIN = 0.13
#: Members of a tile's side.
TILE = 512
#: Numbers (ids, or tiles of wanted documents) sent to every executor at most, where only few texts are wanted.
MOST_BROADCAST = 1_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _GOLDEN, np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The set of word windows of each text, as two rows of independent 64-bit hashes: 128 bits a window,
    sorted and distinct. A-Z count as a-z. With fewer words than ``width`` all of them are one window;
    without words the set is empty."""
    for k, end in batches(texts):
        seen = Segments(texts[k:end], fold=True)
        hashes = seen.hashes, seen.spans(seen.starts, seen.ends, seed=1)
        n = max(0, len(seen.hashes) - width + 1)
        mixed = np.empty((2, n), dtype=np.uint64)
        for row, (h, factor) in enumerate(zip(hashes, _FACTORS, strict=True)):
            one = np.full(n, width, dtype=np.uint64)
            for j in range(width):
                one = mix(one * factor + h[j : j + n])
            mixed[row] = one
        for a, b in zip(seen.first[:-1].tolist(), seen.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield distinct(mixed[:, a : b - width + 1])
            elif b > a:
                few = np.full((2, 1), b - a, dtype=np.uint64)
                for row, (h, factor) in enumerate(zip(hashes, _FACTORS, strict=True)):
                    for x in h[a:b]:
                        few[row] = mix(few[row] * factor + x)
                yield few
            else:
                yield np.zeros((2, 0), dtype=np.uint64)


def distinct(pairs: np.ndarray) -> np.ndarray:
    """Columns of two rows, sorted, each once."""
    order = np.argsort(pairs[0])
    a, b = pairs[0][order], pairs[1][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[keep], b[keep]])


def as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8").reshape(2, -1)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of BLAKE2b over a whole set."""
    digest = hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set as rows of 16-bit numbers.

    Each element emits a Poisson stream of points, dealt to registers at random, so the first point in
    each register is an independent exponential; a register keeps its minimum, and an element stops
    when its stream has passed the largest of them. Registers of a union are maxima of registers.
    """
    sizes = np.array([len(s) for s in sets])
    least = np.full((len(sets), m), np.inf)
    flat = least.ravel()
    alive = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    x, turn = np.zeros(len(alive)), 0
    while len(alive):
        steps = int(np.clip(200_000 // len(alive), 1, 256))
        u = mix(alive[:, None] + (np.arange(turn + 1, turn + steps + 1, dtype=np.uint64) * _GOLDEN)[None, :])
        gaps = -np.log(((u >> np.uint64(24)).astype(float) + 0.5) / float(1 << 40)) / m
        points = x[:, None] + np.cumsum(gaps, axis=1)
        cells = owner[:, None] * m + ((u & np.uint64(0xFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, cells.ravel(), points.ravel())
        x, turn = points[:, -1], turn + steps
        open_docs = np.unique(owner)
        bound = np.zeros(len(sets))
        bound[open_docs] = least[open_docs].max(1)
        on = x < bound[owner]
        alive, owner, x = alive[on], owner[on], x[on]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(level), level, 0), 0, LIMIT + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    parts = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _GOLDEN + parts[:, :, j])
    return key.astype(np.int64)


def likely(n_u, n_v, more, fewer, same, threshold: float) -> np.ndarray:
    """Whether the similarity of greatest joint likelihood is at least ``threshold``.

    Given both set sizes, the chances that a register of one is greater, smaller or equal depend on the
    similarity alone. The log-likelihood is concave in it, so its slope at the threshold tells.
    """
    u = n_u / (n_u + n_v)
    v = 1 - u
    scale, log_b = (BASE - 1) / BASE, np.log(BASE)

    def chance(x):
        return -np.log1p(-x * scale) / log_b, scale / log_b / (1 - x * scale)

    a, b = u - v * threshold, v - u * threshold
    ok = (a > 0) & (b > 0)
    (pa_, da), (pb, db) = chance(np.where(ok, a, 0.5)), chance(np.where(ok, b, 0.5))
    rest = np.maximum(1 - pa_ - pb, 1e-12)
    slope = -more * v * da / pa_ - fewer * u * db / pb + same * (v * da + u * db) / rest
    return ok & (slope >= 0)


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, fp_a, fp_b, registers, bands) of every row of ``docs`` (doc_id, text)."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("neardup")
        for batch in S.slices(batches_):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for k, end in batches(texts):
                sets = list(shingles(texts[k:end], width))
                registers = sketches([s[0] for s in sets])
                keys = band_keys(registers)
                marks = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, end - k), pa.array([s.shape[1] for s in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()),
                     pa.array([r.tobytes() for r in registers], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["doc_id", "n", "fp_a", "fp_b", "registers", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, fp_a long, fp_b long, registers binary, bands array<long>")


def sets_of(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(id, tiles, parts, grams): the full shingle sets of the documents in ``places`` (id, tiles, parts),
    which has an id once. Sets lie beside the tiles they go to, so no join has to deal them by id."""
    places = S.stored(places, "wanted")
    # Few tiles go to the texts; many, and the texts are dealt by id instead.
    n = places.agg(F.sum(F.size("tiles") + 1)).first()[0] or 0
    side = F.broadcast(places) if n <= MOST_BROADCAST else places
    wanted = docs.join(side, docs.doc_id == places.id).select("doc_id", "text", "tiles", "parts")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("neardup")
        for batch in S.slices(batches_):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            found = [s.astype("<u8").tobytes() for s in shingles(texts, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.binary())], ["id", "tiles", "parts", "grams"])

    return S.stored(wanted.mapInArrow(run, "id long, tiles array<long>, parts long, grams binary"), "sets")


def _sides(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Indices of both sides; a tile with one side is compared with itself."""
    left = np.flatnonzero(group["side"] == 0)
    right = np.flatnonzero(group["side"] == 1)
    return (left, right, False) if len(right) else (left, left, True)


def survivors(group: dict[str, np.ndarray], threshold: float) -> list[np.ndarray] | None:
    """(tile, id, label, partners) of members with partners in other components that their registers make
    likely and that they don't meet in an earlier band; the left member of a pair names the right one."""
    left, right, same_side = _sides(group)
    n, label, band = group["n"].astype(float), group["label"], int(group["band"][0])
    registers = np.frombuffer(b"".join(group["registers"]), dtype=np.uint16).reshape(len(n), -1)
    hit = np.zeros(len(n), dtype=bool)
    partners = np.full(len(n), b"", dtype=object)
    for at, i in enumerate(left):
        others = right[at + 1 :] if same_side else right
        others = others[label[others] != label[i]]
        others = others[np.minimum(n[others], n[i]) >= threshold * np.maximum(n[others], n[i])]
        if not len(others):
            continue
        equal = registers[others] == registers[i]
        same = equal.sum(1)
        more = (registers[others] < registers[i]).sum(1)
        ok = likely(n[i], n[others], more, registers.shape[1] - same - more, same, threshold - MARGIN)
        others, equal = others[ok], equal[ok]
        if len(others) and band:
            early = equal[:, : band * ROWS].reshape(len(others), band, ROWS).all(2).any(1)
            others = others[~early]
        if len(others):
            hit[i] = True
            hit[others] = True
            partners[i] = group["id"][others].tobytes()
    at = np.flatnonzero(hit)
    return [group["tile"][at], group["id"][at], label[at], partners[at]] if len(at) else None


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common part of two sets."""
    a, b = (a, b) if a.shape[1] <= b.shape[1] else (b, a)
    at = np.minimum(np.searchsorted(b[0], a[0]), b.shape[1] - 1)
    if (b[0][1:] == b[0][:-1]).any():  # one half shared by two windows
        return len(set(zip(*a.tolist(), strict=True)) & set(zip(*b.tolist(), strict=True)))
    return int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = common_size(a, b)
    return 100 * common >= percent * (a.shape[1] + b.shape[1] - common)


def confirmed(group: dict[str, np.ndarray], percent: int) -> list[np.ndarray] | None:
    """(a, b) of a spanning forest over the links between members of different components: the named
    pairs are held against their full sets, but for those that links found before have joined. Members
    (side 0) and sets (side 1) are rows of their own."""
    sets: dict[int, dict[bytes, np.ndarray]] = {}
    for i in np.flatnonzero(group["side"] == 1):
        sets.setdefault(int(group["id"][i]), {})[group["grams"][i]] = as_set(group["grams"][i])
    members = np.flatnonzero(group["side"] == 0)
    ids = group["id"][members].tolist()
    label = dict(zip(ids, group["label"][members].tolist(), strict=True))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for one, named in zip(ids, group["partners"][members], strict=True):
        for other in np.frombuffer(named, dtype=np.int64).tolist():
            x, y = find(label[one]), find(label[other])
            if x == y:
                continue
            if any(similar(a, b, percent) for a in sets[one].values() for b in sets[other].values()):
                root[max(x, y)] = min(x, y)
                out.append((one, other))
    if not out:
        return None
    pairs = np.array(out, dtype=np.int64)
    return [pairs[:, 0], pairs[:, 1]]


def star_links(group: dict[str, np.ndarray], percent: int) -> list[np.ndarray] | None:
    """(a, b) for the members (side 1) that the hub (side 0) links with."""
    hub = np.flatnonzero(group["side"] == 0)
    if not len(hub):
        return None
    own = as_set(group["grams"][hub[0]])
    found = [group["id"][i] for i in np.flatnonzero(group["side"] == 1) if similar(own, as_set(group["grams"][i]), percent)]
    if not found:
        return None
    return [np.array(found, dtype=np.int64), np.full(len(found), group["id"][hub[0]], dtype=np.int64)]


def likely_pairs(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The (id, hub) pairs that their registers and sizes don't rule out."""
    side = signed.select("doc_id", "n", "registers")
    a = side.select(F.col("doc_id").alias("id"), F.col("n").alias("n_u"), F.col("registers").alias("r_u"))
    b = side.select(F.col("doc_id").alias("hub"), F.col("n").alias("n_v"), F.col("registers").alias("r_v"))
    joined = pairs.join(a, "id").join(b, "hub").where(F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            if not batch.num_rows:
                continue
            r_u, r_v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for k in (4, 5))
            same, more = (r_u == r_v).sum(1), (r_u > r_v).sum(1)
            n_u, n_v = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
            ok = likely(n_u, n_v, more, r_u.shape[1] - same - more, same, threshold - MARGIN)
            yield batch.select(["id", "hub"]).filter(pa.array(ok))

    return joined.select("id", "hub", "n_u", "n_v", "r_u", "r_v").mapInArrow(run, "id long, hub long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * |intersection| >= percent * |union| for their sets of ``width``-word
    shingles; component_id is the smallest doc_id that links lead to, and kept marks it. A null text or
    one without words has an empty set and stands alone; a row with a null id does too, has a null
    component and is kept; rows that share an id are one document as to links; an empty table gives an
    empty result; other columns are ignored. Links below the band probability (see the constants) may go
    unseen: about one in a million at a similarity of 0.85, fewer above.
    """
    threshold = percent / 100
    base = S.small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = S.stored(sign(base, width), "signed")
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Equal sets collapse: only numbers are dealt for that.
    reps = known.groupBy("fp_a", "fp_b", "n").agg(F.min("doc_id").alias("rep"))
    reps = S.stored(reps, "reps")
    with S.scratch(docs.sparkSession) as keep:
        one_each = known.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        banded = one_each.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
        crowded = S.stored(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
        hot = S.hot_keys(crowded, "key", "size")
        members = S.stored(S.join_hot(banded, crowded, "key", hot), "members")

        # The best-connected member becomes the hub of its buckets.
        degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
        hubs = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("best")).select("key", F.col("best.id").alias("hub"))
        hubs = S.stored(hubs, "hubs")
        pairs = S.join_hot(members, hubs, "key", hot).where("id <> hub").select("id", "hub").distinct()
        with S.scratch(docs.sparkSession) as outlive:
            likely_ones = S.stored(likely_pairs(pairs, signed, threshold), "pairs")
            # A star has a tile for every 256 members or so; its hub goes to all of them.
            crowd = likely_ones.groupBy("hub").agg(F.expr("1 + count(*) div 256").alias("parts"))
            met = likely_ones.join(crowd, "hub").select("id", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("tile"), F.lit(0).cast("long").alias("parts"))
            met = met.union(crowd.select("hub", F.lit(None).cast("long"), "parts"))
            sets = sets_of(base, met.groupBy("id").agg(F.collect_set("tile").alias("tiles"), F.max("parts").alias("parts")), width)
            rows = sets.select(F.explode("tiles").alias("tile"), F.lit(1).alias("side"), "id", "grams")
            centres = sets.where("parts > 0").select("id", "grams", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
            centres = centres.select(F.xxhash64("id", "part").alias("tile"), F.lit(0).alias("side"), "id", "grams")
            stars = outlive(tiled(rows.union(centres), "a long, b long", lambda g: star_links(g, percent)), "stars")

        # What hubs left open: buckets with several components.
        first = S.stored(_graph.components(stars), "first")
        labelled = members.join(first.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        with S.scratch(docs.sparkSession) as outlive:
            open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
            hub_label = hubs.join(first.select(F.col("id").alias("hub"), F.col("component").alias("hub_label")), "hub", "left")
            hub_label = hub_label.select("key", F.coalesce("hub_label", "hub").alias("hub_label")).join(open_keys, "key", "left_semi")
            open_ = S.join_hot(labelled, hub_label, "key", hot).withColumn("main", F.col("label") == F.col("hub_label"))
            split = open_.groupBy("key").agg(
                F.expr(f"1 + count_if(main) div {TILE}").alias("mains"), F.expr(f"1 + count_if(NOT main) div {TILE}").alias("others"))
            open_ = S.stored(S.join_hot(open_.select("key", "band", "id", "label", "main"), split, "key", hot), "open")
            # Blocks 0 .. others - 1 hold the others, the following ones the hub's component, of which two
            # blocks never meet. A block meets itself as one side.
            draw = F.xxhash64("id")
            block = F.when(F.col("main"), F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others")))
            blocks = F.col("others") + F.col("mains")
            meets = F.when(F.col("main"), F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
            dealt = open_.withColumn("block", block).withColumn("with", F.explode(meets))
            lo, hi = F.least("block", "with"), F.greatest("block", "with")
            dealt = dealt.select(
                F.xxhash64("key", lo, hi).alias("tile"), F.when(F.col("block") == lo, 0).otherwise(1).alias("side"), "id", "label", "band")
            sizes = signed.select(F.col("doc_id").alias("id"), "n", "registers")
            found = tiled(dealt.join(sizes, "id"), "tile long, id long, label long, partners binary", lambda g: survivors(g, threshold))
            found = S.stored(found, "survivors")
            more_sets = sets_of(base, found.groupBy("id").agg(F.collect_set("tile").alias("tiles")).withColumn("parts", F.lit(0).cast("long")), width)
            none = F.lit(None).cast("binary")
            to_confirm = found.select("tile", F.lit(0).alias("side"), "id", "label", "partners", none.alias("grams")).union(
                more_sets.select(F.explode("tiles"), F.lit(1), "id", "id", none, "grams"))
            rest = outlive(tiled(to_confirm, "a long, b long", lambda g: confirmed(g, percent)), "rest")
        final = keep(first if rest.isEmpty() else _graph.components(stars.union(rest)), "final")

    component = F.coalesce("component", "rep", "doc_id")
    whole = signed.select("doc_id", "n", "fp_a", "fp_b").join(reps, ["fp_a", "fp_b", "n"], "left")
    whole = whole.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    whole = whole.join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one document of each group; columns as they are. Rows with equal ids (null
    ones too) and equal texts are copies as well, of which any one stays."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    gone = S.stored(gone.distinct(), "gone")
    few = lambda ids: F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    left = docs.join(few(gone), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    # Only rows that share an id are dealt out with their texts.
    twice = S.stored(left.groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice"), "twice")
    if twice.isEmpty():
        return left
    shared = F.col("doc_id").eqNullSafe(F.col("_twice"))
    copies = left.join(few(twice), shared, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(few(twice), shared, "left_anti").unionByName(copies)
