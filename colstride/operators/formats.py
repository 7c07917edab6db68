"""Choosing a format for each page of a column by its data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .codecs import CODES, PAGE, _of_pages, _pages, _slices, _through

#: A selector: (page number, values) -> format code, with the encoded page if it was made on the way.
Selector = Callable[[int, np.ndarray], int | tuple[int, bytes | None]]


def kernel_of(code: int):
    """The format of a code; 1 .. 64 are static widths."""
    return K.StaticVbp(code) if 1 <= code <= 64 else CODES[code]


def static_choice(code: int) -> Selector:
    return lambda page, values: code


def random_choice(seed: int) -> Selector:
    """One of the formats without a width of their own, the same for a page in every run."""
    codes = sorted(CODES)
    return lambda page, values: codes[int(np.random.default_rng([seed, page]).integers(len(codes)))]


def exhaustive_choice(best: bool = True) -> Selector:
    """The format of least size (or of greatest), found by encoding the page in each.

    The page's static width counts with the bytes its formula gives. It is where the search for the least
    starts if fewer than 64 bits do, the uncompressed format where not and for the greatest; from there a
    format must be strictly smaller, or at least as large, in the order of the codes.
    """

    def choose(page: int, values: np.ndarray) -> tuple[int, bytes | None]:
        width = K.width_of(values)
        code, data, size = 0, None, 8 * len(values)
        if best and width < 64:
            code, size = width, width * len(values) // 8
        for other in sorted(c for c in CODES if c):
            made = CODES[other].encode(values)
            if len(made) < size if best else len(made) >= size:
                code, data, size = other, made, len(made)
        return code, data

    return choose


def _chosen(selector: Selector, page: int, values: np.ndarray) -> tuple[int, bytes | None]:
    found = selector(page, values)
    return found if isinstance(found, tuple) else (found, None)


def choices(column: DataFrame, selector: Selector, page: int = PAGE) -> DataFrame:
    """(page, n, code)."""
    return _pages(column, page, "page long, n long, code long", lambda p, v: (p, len(v), _chosen(selector, p, v)[0]))


def encode_each(column: DataFrame, selector: Selector, page: int = PAGE) -> DataFrame:
    """(page, n, code, data): every page in the format that the selector chooses for it, encoded once."""

    def work(p: int, v: np.ndarray) -> tuple:
        code, data = _chosen(selector, p, v)
        return p, len(v), code, kernel_of(code).encode(v) if data is None else data

    return _pages(column, page, "page long, n long, code long, data binary", work)


def decode_each(pages: DataFrame, page: int = PAGE) -> DataFrame:
    """(pos, v) of pages in different formats."""

    def run(batches):
        for batch in _slices(batches):
            for p, n, code, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = kernel_of(code).decode(data, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * page, p * page + n)), pa.array(values.astype(np.uint64).view(np.int64))], ["pos", "v"])

    return _through(_of_pages(pages, "page", "n", "code", "data"), run, "pos long, v long")
