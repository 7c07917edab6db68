"""Round trips of every format over widths and lengths, and format selection."""

import numpy as np
import pytest

from colstride.operators import codecs, formats
from colstride.operators import kernels as K
from colstride.sources.columns import from_values

KERNELS = {
    "uncompressed": K.Uncompressed(), "static": K.StaticVbp(), "static lanes": K.StaticVbp(lanes=4), "padded": K.PaddedVbp(lanes=2), "dynamic": K.DynamicVbp(),
    "dynamic lanes": K.DynamicVbp(128, 2), "k-wise 1": K.NullSuppression(1), "k-wise 2": K.NullSuppression(2), "simple": K.GroupSimple(), "simple lanes": K.GroupSimple(4),
    "delta": K.Delta(), "delta 4": K.Delta(K.GroupSimple(4), 4), "for": K.Reference(), "for simple": K.Reference(K.GroupSimple()), "rle": K.RunLength(),
    "for delta": K.Reference(K.Delta(K.StaticVbp())),
}


@pytest.mark.parametrize("name", KERNELS)
def test_round_trip(name):
    kernel, rng = KERNELS[name], np.random.default_rng(7)
    for width in (1, 2, 3, 7, 8, 13, 21, 32, 33, 63, 64):
        for n in (0, 1, 2, 17, 100, 101, 1234):
            values = rng.integers(0, (1 << width) - 1, n, dtype=np.uint64, endpoint=True)
            for data in (values, np.sort(values)):
                assert (kernel.decode(kernel.encode(data), n) == data).all()


def test_static_width_is_checked():
    with pytest.raises(ValueError):
        K.StaticVbp(3).encode(np.array([8], dtype=np.uint64))


def test_group_simple_packs_tightly():
    assert len(K.GroupSimple().plan(np.ones(64, dtype=np.uint64))[0]) == 1
    assert len(K.GroupSimple().plan(np.full(3, 1 << 40, dtype=np.uint64))[0]) == 3


def test_column_round_trips(spark):
    values = [int(x) for x in np.random.default_rng(3).integers(0, 1000, 300)]
    column = from_values(spark, values)
    for kernel in (K.DynamicVbp(), K.GroupSimple(2)):
        pages = codecs.encode(column, kernel, page=64)
        assert [r.v for r in codecs.decode(pages, kernel, 64).orderBy("pos").collect()] == values
        again = codecs.morph(pages, kernel, K.RunLength(), 64)
        assert [r.v for r in codecs.decode(again, K.RunLength(), 64).orderBy("pos").collect()] == values
    assert codecs.morph(pages, kernel, kernel) is pages


@pytest.mark.parametrize("step", [1, 4])
def test_delta_windows(spark, step):
    values = [int(x) for x in np.random.default_rng(4).integers(0, 1000, 200)]
    column = from_values(spark, values)
    encoded = codecs.delta_encode(column, 64, step)
    assert [r.v for r in encoded.orderBy("pos").collect()][:step] == values[:step]
    assert [r.v for r in codecs.delta_decode(encoded, 64, step).orderBy("pos").collect()] == values
    assert [r.v for r in codecs.for_decode(codecs.for_encode(column, 64)).orderBy("pos").collect()] == values


def test_runs_cross_seams(spark):
    values = [5] * 25 + [6] + [5] * 4 + [7] * 20
    runs = codecs.rle_encode(from_values(spark, values), ranges=10)
    assert [tuple(r) for r in runs.orderBy("pos").collect()] == [(0, 5, 25), (25, 6, 1), (26, 5, 4), (30, 7, 20)]
    assert [r.v for r in codecs.rle_decode(runs).orderBy("pos").collect()] == values


def test_random_access_and_streaming_core(spark):
    values = list(range(0, 600, 2))
    column, kernel = from_values(spark, values), K.Delta()
    pages = codecs.encode(column, kernel, page=128)
    at = spark.createDataFrame([(3,), (299,), (130,)], "pos long")
    assert {r.pos: r.v for r in codecs.read_at(pages, at, kernel, 128).collect()} == {3: 6, 299: 598, 130: 260}


def sizes_of(values):
    """Bytes of a page in each format that an exhaustive choice weighs."""
    width = K.width_of(values)
    sizes = {code: len(kernel.encode(values)) for code, kernel in codecs.CODES.items()}
    return sizes | ({width: width * len(values) // 8} if width < 64 else {})


def test_random_access_reads_packed_values():
    rng = np.random.default_rng(3)
    for width in (1, 5, 11, 31, 57, 58, 63, 64):
        values = rng.integers(0, 1 << min(width, 63), 301, dtype=np.uint64) | np.uint64(1 << (width - 1))
        where = rng.integers(0, 301, 50)
        for kernel in (K.Uncompressed(), K.StaticVbp(), K.StaticVbp(lanes=4), K.PaddedVbp(), K.PaddedVbp(lanes=8)):
            assert (kernel.at(kernel.encode(values), len(values), where) == values[where]).all()


@pytest.mark.parametrize("kernel", [K.NullSuppression(), K.NullSuppression(1), K.GroupSimple(), K.GroupSimple(4)])
def test_formats_against_plain_loops(kernel):
    """The bytes that value-by-value and block-by-block encoding gives."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 63, 64, 65, 500):
        for bits in (1, 3, 17, 64):
            values = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(64 - bits, 64, n).astype(np.uint64)
            data = kernel.encode(values)
            assert data == (plain_null_suppression if isinstance(kernel, K.NullSuppression) else plain_group_simple)(kernel, values.tolist())
            assert (kernel.decode(data, n) == values).all()


def plain_null_suppression(kernel, values):
    out = bytearray()
    for at in range(0, len(values), kernel.k):
        group = values[at : at + kernel.k]
        sizes = [max(1, -(-v.bit_length() // 8)) for v in group]
        out.append(sum((8 - s) << (3 * i) for i, s in enumerate(sizes)))
        for v, s in zip(group, sizes):
            out += v.to_bytes(s, "little")
    return bytes(out)


def plain_group_simple(kernel, values):
    rows = [values[k : k + kernel.lanes] + [0] * (kernel.lanes - len(values[k : k + kernel.lanes])) for k in range(0, len(values), kernel.lanes)]
    at, selectors, words = 0, [], []
    while at < len(rows):
        s = next(s for s, n in enumerate(K.GROUPS) if all(v < 1 << 64 // n for row in rows[at : at + n] for v in row))
        own = rows[at : at + K.GROUPS[s]]
        words += [sum(row[lane] << (64 // K.GROUPS[s] * i) for i, row in enumerate(own)) for lane in range(kernel.lanes)]
        selectors.append(s)
        at += K.GROUPS[s]
    head = bytes(a | b << 4 for a, b in zip(selectors[0::2], [*selectors[1::2], 0]))
    return len(selectors).to_bytes(8, "little") + head + b"".join(w.to_bytes(8, "little") for w in words)


def test_packed_positions(spark):
    positions = spark.createDataFrame([(p,) for p in (3, 7, 8, 150, 4)], "pos long")
    packed = codecs.pack_positions(positions, page=2)
    assert sorted(r.pos for r in codecs.unpack_positions(packed, page=2).collect()) == [3, 4, 7, 8, 150]
    data = from_values(spark, list(range(1000, 1200)))
    assert [r.v for r in codecs.project_packed(data, packed, page=2).orderBy("pos").collect()] == [1003, 1004, 1007, 1008, 1150]


def test_selectors(spark):
    small, sequence = np.ones(2048, dtype=np.uint64), np.arange(10**12, 10**12 + 2048, dtype=np.uint64)
    best, worst = formats.exhaustive_choice(), formats.exhaustive_choice(False)
    for values in (small, sequence, np.random.default_rng(1).integers(0, 1 << 63, 2048, dtype=np.uint64)):
        sizes = sizes_of(values)
        assert sizes[best(0, values)[0]] == min(sizes.values())
        assert sizes[worst(0, values)[0]] == max(v for k, v in sizes.items() if k == 0 or k > 64)
    assert best(0, sequence)[0] in (67, 68)
    assert formats.static_choice(65)(0, small) == 65
    choose = formats.random_choice(5)
    assert [choose(p, small) for p in range(20)] == [choose(p, small) for p in range(20)] and len({choose(p, small) for p in range(40)}) > 3
    column = from_values(spark, [3] * 100 + list(range(1000, 1100)))
    pages = formats.encode_each(column, best, page=100)
    whole = np.array([3] * 100 + list(range(1000, 1100)), dtype=np.uint64)
    for chooser in (best, worst):
        chosen = {r.page: r.code for r in formats.choices(column, chooser, page=100).collect()}
        for p, code in chosen.items():
            sizes = sizes_of(whole[p * 100 : p * 100 + 100])
            assert sizes[code] == (min(sizes.values()) if chooser is best else max(v for k, v in sizes.items() if k == 0 or k > 64))
    assert [r.v for r in formats.decode_each(pages, 100).orderBy("pos").collect()] == [3] * 100 + list(range(1000, 1100))


def test_chained_steps_share_a_worker(spark):
    """Encoding, another format and decoding are one Python step; a cached or changed frame begins a new one."""
    column = spark.range(5000).selectExpr("id AS pos", "id % 300 AS v")
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    plain, kernel = codecs.NAMES["uncompressed"], codecs.NAMES["dynamic_vbp"]
    pages = codecs.encode(column, plain)
    found = codecs.decode(codecs.morph(pages, plain, kernel), kernel)
    mixed = formats.decode_each(formats.encode_each(column, formats.exhaustive_choice()))
    part = codecs.decode(pages.where("page > 0"), plain)
    assert (steps(found), steps(mixed), steps(part)) == (1, 1, 2)
    expected = [(k, k % 300) for k in range(5000)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in mixed.collect()) == expected
    assert sorted(tuple(r) for r in part.collect()) == expected[2048:]
    pages.cache()
    assert sorted(tuple(r) for r in codecs.decode(pages, plain).collect()) == expected
    pages.unpersist()


def test_few_pages_are_held_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"page": list(range(1000))})
    parts = list(codecs._slices([batch]))
    assert max(p.num_rows for p in parts) == codecs.PAGES_HELD and [v for p in parts for v in p.column(0).to_pylist()] == list(range(1000))
