"""Lightweight compression of one page of unsigned 64-bit values, as numpy kernels.

``encode(values) -> bytes`` and ``decode(bytes, n) -> values`` for every format. ``lanes`` is the one
trace of vector width in the data: values are dealt to lanes in turn, and each lane is packed on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64


def width_of(values: np.ndarray) -> int:
    """Bits that every value fits in; at least 1."""
    return max(1, int(np.bitwise_or.reduce(values)).bit_length()) if len(values) else 1


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits one after the other, lowest bit first."""
    bits = (values[:, None] >> np.arange(width, dtype=U)[None, :]) & U(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(U) << np.arange(width, dtype=U)[None, :]).sum(1, dtype=U)


def to_lanes(values: np.ndarray, lanes: int) -> np.ndarray:
    """Reorder so that the values of a lane stand together; only whole rows of lanes take part."""
    whole = len(values) // lanes * lanes
    return np.concatenate([values[:whole].reshape(-1, lanes).T.ravel(), values[whole:]])


def from_lanes(values: np.ndarray, lanes: int) -> np.ndarray:
    whole = len(values) // lanes * lanes
    return np.concatenate([values[:whole].reshape(lanes, -1).T.ravel(), values[whole:]])


def place_in_lanes(where: np.ndarray, n: int, lanes: int) -> np.ndarray:
    """Where ``to_lanes`` puts the values at some places of n."""
    rows = n // lanes
    return np.where(where < rows * lanes, where % lanes * rows + where // lanes, where)


@dataclass(frozen=True)
class Uncompressed:
    def encode(self, values: np.ndarray) -> bytes:
        return values.astype("<u8").tobytes()

    def at(self, data: bytes, n: int, where: np.ndarray) -> np.ndarray:
        return np.frombuffer(data, dtype="<u8", count=n)[where].astype(U)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, dtype="<u8", count=n).astype(U)


@dataclass(frozen=True)
class StaticVbp:
    """One width for all values: ``width``, or what the page needs (kept in its first byte)."""

    width: int | None = None
    lanes: int = 1

    def encode(self, values: np.ndarray) -> bytes:
        width = self.width or width_of(values)
        if width_of(values) > width:
            raise ValueError("a value needs more bits than the format has")
        return bytes([width]) + pack_bits(to_lanes(values, self.lanes), width)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return from_lanes(unpack_bits(data[1:], data[0], n), self.lanes)

    def at(self, data: bytes, n: int, where: np.ndarray) -> np.ndarray:
        """The values at some places, read where they lie."""
        width = data[0]
        raw = np.frombuffer(data + b"\0" * 16, dtype=np.uint8)
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        bit = place_in_lanes(where, n, self.lanes) * width + 8
        byte, shift = bit >> 3, (bit & 7).astype(U)
        # A value of over 57 bits may reach into a ninth byte.
        high = np.where(shift > 0, raw[byte + 8].astype(U) << (U(63) - shift) << U(1), U(0))
        return (eight[byte] >> shift | high) & U((1 << width) - 1)


@dataclass(frozen=True)
class PaddedVbp:
    """One width; a value never straddles two 64-bit words, whose spare bits stay empty."""

    width: int | None = None
    lanes: int = 1

    def encode(self, values: np.ndarray) -> bytes:
        width = self.width or width_of(values)
        per = 64 // width
        padded = np.zeros(-(-len(values) // per) * per, dtype=U)
        padded[: len(values)] = to_lanes(values, self.lanes)
        shifts = np.arange(per, dtype=U) * U(width)
        words = np.bitwise_or.reduce(padded.reshape(-1, per) << shifts[None, :], axis=1) if len(values) else padded
        return bytes([width]) + words.astype("<u8").tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        width = data[0]
        per = 64 // width
        words = np.frombuffer(data, dtype="<u8", offset=1).astype(U)
        mask = U((1 << width) - 1)
        values = (words[:, None] >> (np.arange(per, dtype=U) * U(width))[None, :]) & mask
        return from_lanes(values.ravel()[:n], self.lanes)

    def at(self, data: bytes, n: int, where: np.ndarray) -> np.ndarray:
        width = data[0]
        place, per = place_in_lanes(where, n, self.lanes), 64 // width
        words = np.frombuffer(data, dtype="<u8", offset=1).astype(U)
        return words[place // per] >> (place % per * width).astype(U) & U((1 << width) - 1)


@dataclass(frozen=True)
class DynamicVbp:
    """Blocks of ``block`` values, each with its own width of one byte; widths stand together."""

    block: int = 64
    lanes: int = 1

    def encode(self, values: np.ndarray) -> bytes:
        parts = [values[k : k + self.block] for k in range(0, len(values), self.block)]
        widths = [width_of(p) for p in parts]
        return bytes(widths) + b"".join(pack_bits(to_lanes(p, self.lanes), w) for p, w in zip(parts, widths, strict=True))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        blocks, at, out = -(-n // self.block), -(-n // self.block), []
        for k in range(blocks):
            m = min(self.block, n - k * self.block)
            size = -(-m * data[k] // 8)
            out.append(from_lanes(unpack_bits(data[at : at + size], data[k], m), self.lanes))
            at += size
        return np.concatenate(out) if out else np.zeros(0, dtype=U)


@dataclass(frozen=True)
class NullSuppression:
    """Groups of ``k`` values: a descriptor byte with 3 bits of leading zero bytes for each, then the rest."""

    k: int = 2

    def encode(self, values: np.ndarray) -> bytes:
        sizes = -(-bit_lengths(values) // 8)
        group = np.arange(len(values)) // self.k
        heads = np.zeros(-(-len(values) // self.k), dtype=np.int64)
        np.add.at(heads, group, (8 - sizes) << 3 * (np.arange(len(values)) % self.k))
        # A value lies behind those before it and the descriptors up to its own.
        start = np.cumsum(sizes) - sizes + group + 1
        out = np.zeros(int(sizes.sum()) + len(heads), dtype=np.uint8)
        out[start[:: self.k] - 1] = heads
        k = np.arange(8)
        used = k[None, :] < sizes[:, None]
        out[(start[:, None] + k[None, :])[used]] = values.astype("<u8").view(np.uint8).reshape(-1, 8)[used]
        return out.tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        raw = np.frombuffer(data, dtype=np.uint8)
        sizes = 8 - (raw[:, None].astype(np.int64) >> 3 * np.arange(self.k)[None, :] & 7)
        # Where the next group would begin if a descriptor stood at each place.
        heads = chain(np.arange(len(raw)) + 1 + sizes.sum(1), -(-n // self.k))
        own = sizes[heads]
        start = (heads[:, None] + 1 + np.cumsum(own, axis=1) - own).ravel()[:n]
        own = own.ravel()[:n]
        k = np.arange(8)
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        parts = np.where(k[None, :] < own[:, None], padded[np.minimum(start[:, None] + k[None, :], len(padded) - 1)], 0).astype(np.uint8)
        return np.ascontiguousarray(parts).view("<u8").ravel().astype(U)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs 1."""
    rest, out = values.astype(U), np.ones(len(values), dtype=np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        high = rest >> U(k) > 0
        out += k * high
        rest = np.where(high, rest >> U(k), rest)
    return out


def chain(after: np.ndarray, n: int) -> np.ndarray:
    """The first n places of the walk that begins at 0 and goes from each place to ``after`` it; in as many
    rounds as n has bits."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    jump = np.append(np.minimum(after, len(after)), len(after))
    places = np.zeros(1, dtype=np.int64)
    while len(places) < n:
        places = np.concatenate([places, jump[places]])
        jump = jump[jump]
    return places[:n]


#: Groups in a block of the group-simple format, by selector: fixed values of the format.
GROUPS = (64, 32, 21, 16, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1)


@dataclass(frozen=True)
class GroupSimple:
    """Blocks of one word per lane that hold as many groups (one value for each lane) as fit with equal
    widths; two selectors of 4 bits share a byte. The last, incomplete block takes the widest fit."""

    lanes: int = 1

    def plan(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(selectors, first group of each block, values padded to whole groups)."""
        padded = np.zeros(-(-len(values) // self.lanes) * self.lanes, dtype=U)
        padded[: len(values)] = values
        widths = bit_lengths(padded.reshape(-1, self.lanes).max(1, initial=0))
        n = len(widths)
        fit = np.full(n, len(GROUPS) - 1)
        for s in reversed(range(len(GROUPS))):
            # The next group that is too wide; fewer groups than the block holds may close the page.
            wide = np.where(widths > 64 // GROUPS[s], np.arange(n), n)
            nearest = np.minimum.accumulate(wide[::-1])[::-1] if n else wide
            fit[nearest >= np.minimum(np.arange(n) + GROUPS[s], n)] = s
        starts = chain(np.arange(n) + np.array(GROUPS)[fit], n)
        starts = starts[starts < n]
        return fit[starts], starts, padded

    def encode(self, values: np.ndarray) -> bytes:
        selectors, starts, padded = self.plan(values)
        sizes = np.array(GROUPS)[selectors]
        slot = np.arange(len(padded) // self.lanes) - np.repeat(starts, np.diff(np.append(starts, len(padded) // self.lanes)))
        bits = np.repeat(64 // sizes, np.diff(np.append(starts, len(padded) // self.lanes)))
        shifted = padded.reshape(-1, self.lanes) << (slot * bits).astype(U)[:, None]
        body = np.bitwise_or.reduceat(shifted, starts, axis=0).astype("<u8").tobytes() if len(starts) else b""
        pairs = np.append(selectors, np.zeros(len(selectors) % 2, dtype=np.int64)).reshape(-1, 2)
        return len(selectors).to_bytes(8, "little") + (pairs[:, 0] | pairs[:, 1] << 4).astype(np.uint8).tobytes() + body

    def decode(self, data: bytes, n: int) -> np.ndarray:
        count = int.from_bytes(data[:8], "little")
        packed = np.frombuffer(data, dtype=np.uint8, count=-(-count // 2), offset=8)
        selectors = np.stack([packed & 15, packed >> 4], axis=1).ravel()[:count]
        words = np.frombuffer(data, dtype="<u8", offset=8 + len(packed)).astype(U).reshape(-1, self.lanes)
        sizes = np.array(GROUPS)[selectors]
        bits = np.repeat(64 // sizes, sizes)
        slot = np.arange(len(bits)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = U((1 << 64) - 1) >> (64 - bits).astype(U)
        return (np.repeat(words, sizes, axis=0) >> (slot * bits).astype(U)[:, None] & mask[:, None]).ravel()[:n]


@dataclass(frozen=True)
class Delta:
    """Differences to the value ``step`` places before, modulo 2 ** 64; the first ``step`` stay."""

    inner: object = DynamicVbp()
    step: int = 1

    def encode(self, values: np.ndarray) -> bytes:
        out = values.copy()
        out[self.step :] = values[self.step :] - values[: -self.step or None][: len(values) - self.step]
        return self.inner.encode(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        out = self.inner.decode(data, n).copy()
        for lane in range(min(self.step, n)):
            out[lane :: self.step] = np.cumsum(out[lane :: self.step], dtype=U)
        return out


@dataclass(frozen=True)
class Reference:
    """Frame of reference: differences to the least value, which comes first."""

    inner: object = DynamicVbp()

    def encode(self, values: np.ndarray) -> bytes:
        least = values.min() if len(values) else U(0)
        return int(least).to_bytes(8, "little") + self.inner.encode(values - least)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return self.inner.decode(data[8:], n) + U(int.from_bytes(data[:8], "little"))


@dataclass(frozen=True)
class RunLength:
    """Pairs of value and run length."""

    def encode(self, values: np.ndarray) -> bytes:
        if not len(values):
            return b""
        start = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        length = np.diff(np.concatenate([start, [len(values)]])).astype(U)
        return np.stack([values[start], length], axis=1).astype("<u8").tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        pairs = np.frombuffer(data, dtype="<u8").astype(U).reshape(-1, 2)
        return np.repeat(pairs[:, 0], pairs[:, 1].astype(np.int64))
