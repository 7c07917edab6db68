"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colstride.operators import formats
from colstride.operators import kernels as K
from test_codecs import sizes_of

from colstride.sources.generators import histogram_counts

VALUES = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**20), st.integers(0, 2**64 - 1)), max_size=300).map(lambda x: np.array(x, dtype=np.uint64))
KERNELS = st.sampled_from(
    [K.Uncompressed(), K.StaticVbp(), K.PaddedVbp(), K.DynamicVbp(16), K.NullSuppression(2), K.GroupSimple(2), K.Delta(K.GroupSimple(), 2), K.Reference(K.DynamicVbp(8, 4)), K.RunLength()]
)


@settings(max_examples=150, deadline=None)
@given(VALUES, KERNELS)
def test_codecs_lose_nothing(values, kernel):
    assert (kernel.decode(kernel.encode(values), len(values)) == values).all()


@settings(max_examples=60, deadline=None)
@given(VALUES.filter(len))
def test_the_best_format_is_no_larger_than_any(values):
    code, data = formats.exhaustive_choice()(0, values)
    sizes = sizes_of(values)
    assert data is None or data == formats.kernel_of(code).encode(values)
    assert sizes[code] == min(sizes.values()) and (formats.kernel_of(code).decode(formats.kernel_of(code).encode(values), len(values)) == values).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 5000), st.lists(st.integers(0, 255), min_size=64, max_size=64).filter(any))
def test_histograms_add_up(n, weights):
    counts = histogram_counts(n, weights)
    assert sum(counts) == n and all(c == 0 for c, w in zip(counts, weights) if w == 0)
