"""Whole texts as byte vectors: words, their hashes and exact comparison, without a loop per word."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: A-Z as a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: ASCII white space: the gaps between words.
IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of the longest word that is hashed eight bytes at a time and remembered; longer ones take BLAKE2b.
LONG = 64
#: What is left of eight bytes when only the first 0, 1, ... 8 of them count.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Segments:
    """Words of many texts: ``starts`` and ``ends`` in ``data``, ``hashes``, and for text i the words
    from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: list[bytes], fold: bool = False, is_gap: np.ndarray = IS_GAP):
        padded = np.frombuffer(b"\n".join([b"", *texts, b"\0" * 8]), dtype=np.uint8)
        if fold:
            padded = FOLD[padded]
        self.data = padded[:-8]
        # The eight bytes that begin at each place.
        self._eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        begin = np.cumsum([1, *[len(t) + 1 for t in texts]])
        gap = is_gap[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # the data begin and end with a gap
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, begin)
        self.hashes = self.spans(self.starts, self.ends)

    def _bytes_at(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self._eight[starts] & _MASK[np.minimum(sizes, 8)]

    def spans(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of any byte ranges; equal bytes hash alike wherever they stand, and seeds give
        hashes that are independent of each other."""
        sizes = ends - starts
        start = np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
        h = mix((sizes.astype(np.uint64) * _GOLDEN + start) ^ self._bytes_at(starts, sizes))
        more, k = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
        while len(more):
            h[more] = mix(mix(h[more] + start) ^ self._bytes_at(starts[more] + k, sizes[more] - k))
            k += 8
            more = more[sizes[more] > k]
        for i in np.flatnonzero(sizes > LONG).tolist():
            digest = hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(digest, "little")
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words with these numbers hold the same bytes, pair by pair."""
        size = self.ends[a] - self.starts[a]
        other = self.ends[b] - self.starts[b]
        equal = (size == other) & (self._bytes_at(self.starts[a], size) == self._bytes_at(self.starts[b], other))
        rest = np.flatnonzero(equal & (size > 8) & (a != b))
        if len(rest):
            equal[rest] = same_ranges(self.data, self.starts[a[rest]], self.data, self.starts[b[rest]], size[rest])
        return equal

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


def same_ranges(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ranges of x that start at a equal those of y that start at b; none is empty."""
    if not len(sizes):
        return np.zeros(0, dtype=bool)
    differ = x[places(a, sizes)] != y[places(b, sizes)]
    return ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)


def batches(texts: list[bytes], most: int = 500_000):
    """(from, to) ranges of ``texts`` of at most ``most`` bytes together; one larger text stands alone."""
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield k, end
        k = end


class Memo:
    """A bounded memory from 64-bit keys to small integers (slots or counts), as sorted arrays.

    New keys gather in a small pair of arrays that is merged into the large one now and then, so adding
    costs no copy of everything.
    """

    def __init__(self, most: int):
        self.most = most
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.late = (self.keys, self.values)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, values) for sorted distinct keys."""
        known, values = self._look(self.keys, self.values, wanted)
        if len(self.late[0]) and len(rest := np.flatnonzero(~known)):
            found, late = self._look(*self.late, wanted[rest])
            known[rest], values[rest] = found, late
        return known, values

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add sorted distinct keys that aren't known."""
        at = np.searchsorted(self.late[0], keys)
        self.late = np.insert(self.late[0], at, keys), np.insert(self.late[1], at, values)
        if len(self.late[0]) > 20_000 + len(self.keys) // 8:
            at = np.searchsorted(self.keys, self.late[0])
            self.keys, self.values = np.insert(self.keys, at, self.late[0]), np.insert(self.values, at, self.late[1])
            self.late = self.late[0][:0], self.late[1][:0]

    @property
    def full(self) -> bool:
        return len(self.keys) + len(self.late[0]) >= self.most

    def clear(self) -> None:
        self.__init__(self.most)


class Growing:
    """An array that grows by doubling its room."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1024, dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordMemory:
    """A bounded memory of what was worked out for each word. Hashes find a word, its bytes decide: words
    that share a hash never share a value."""

    def __init__(self, most: int):
        self.memo = Memo(most)
        self.data, self.start, self.size, self.value = Growing(np.uint8), Growing(np.int64), Growing(np.int64), Growing(np.int64)

    @property
    def full(self) -> bool:
        return self.memo.full

    def values(self, seen: Segments, work: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
        """The value of every word of ``seen``; ``work`` gives those of words that aren't known."""
        keys, where, back = np.unique(seen.hashes, return_index=True, return_inverse=True)
        known, slots = self.memo.find(keys)
        hits = np.flatnonzero(known)
        held, at = slots[hits], where[hits]
        sizes = seen.ends[at] - seen.starts[at]
        good = self.size.room[held] == sizes
        fits = np.flatnonzero(good)
        good[fits] = same_ranges(self.data.room, self.start.room[held[fits]], seen.data, seen.starts[at[fits]], sizes[fits])
        out = np.zeros(len(keys), dtype=np.int64)
        out[hits] = self.value.room[held]
        new = np.concatenate([np.flatnonzero(~known), hits[~good]])
        # Words that share a hash with another one of these texts.
        odd = np.flatnonzero(~seen.same(np.arange(len(back)), where[back]))
        if len(new) + len(odd):
            got = work([seen.word(i) for i in [*where[new].tolist(), *odd.tolist()]])
            out[new] = got[: len(new)]
            keep = np.flatnonzero(~known)
            sizes = seen.ends[where[keep]] - seen.starts[where[keep]]
            keep = keep[sizes <= LONG]
            self._add(keys[keep], seen, where[keep], out[keep])
        each = out[back]
        if len(odd):
            each[odd] = got[len(new) :]
        return each

    def _add(self, keys: np.ndarray, seen: Segments, words: np.ndarray, values: np.ndarray) -> None:
        sizes = seen.ends[words] - seen.starts[words]
        self.memo.add(keys, self.value.n + np.arange(len(keys)))
        self.start.extend(self.data.n + np.cumsum(sizes) - sizes)
        self.data.extend(seen.data[places(seen.starts[words], sizes)])
        self.size.extend(sizes)
        self.value.extend(values)
