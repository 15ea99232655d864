"""Whole-batch text arithmetic on Arrow buffers: words, rolling hashes and shingles without a Python
object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text that is worked on at once; one longer document is taken alone.
SLICE_BYTES = 2 << 20

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) of an array that may be overwritten."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Rolling:
    """Polynomial hashes, modulo 2**64, of any range of a buffer of bytes."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
        self.base = (int(rng.integers(1, 2**62)) * 8 + 5) % 2**64
        self.inverse = pow(self.base, -1, 2**64)
        self.pow = self.back = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.pow) <= n:
            n = max(n + 1, SLICE_BYTES + 1)
            for name, base in (("pow", self.base), ("back", self.inverse)):
                p = np.full(n, _U(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """h with h[i] the unnormalised hash of values[:i], 64-bit numbers."""
        self._grow(len(values))
        h = np.zeros(len(values) + 1, _U)
        np.cumsum(values * self.pow[: len(values)], out=h[1:])
        return h

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """h with h[i] the unnormalised hash of data[:i], bytes."""
        return self.sums(self.table[data])

    def ranges(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], equal for equal bytes anywhere."""
        return (h[end] - h[start]) * self.back[start]


class PairRolling(Rolling):
    """Hashes of ranges of two bytes or more, summed over overlapping pairs of bytes: unlike sums over
    single bytes modulo 2**64, they do not cancel in self-similar text."""

    def __init__(self, seed: int) -> None:
        super().__init__(seed)
        self.pairs = np.random.default_rng(seed + 1000).integers(0, 2**64, 1 << 16, dtype=_U)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return self.sums(self.pairs[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]])

    def ranges(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (h[end - 1] - h[start]) * self.back[start]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, "right")) - 1)
        to = min(to, len(column))
        yield row, to, raw[off[row] : off[to]], off[row : to + 1] - off[row]
        row = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word, first word of each document): runs without ASCII white space that do
    not cross documents."""
    inside = ~_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


class WordHashes:
    """64-bit hashes of words with A-Z in lower case."""

    def __init__(self, seed: int) -> None:
        self.rolling = Rolling(seed)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first hash of each document)"""
        data = _LOWER[data]
        start, end, at = words(data, off)
        return mix(self.rolling.ranges(self.rolling.prefix(data), start, end) + (end - start).astype(_U)), at


class Shingler:
    """64-bit hashes of the shingles of ``width`` words; a shorter document is one shingle, and one
    without words has none."""

    def __init__(self, width: int = 5, seed: int = 11) -> None:
        self.width, self.hashes = width, WordHashes(seed)
        self.odd = np.random.default_rng(seed + 1).integers(1, 2**63, width, dtype=_U) * _U(2) + _U(1)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first hash of each document), in text order, repeats kept."""
        h, at = self.hashes(data, off)
        count, k = np.diff(at), self.width
        n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
        out_at = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(out_at[-1], _U)
        if len(h) >= k:
            full = sum((h[j : len(h) - k + 1 + j] * self.odd[j] for j in range(k)), np.zeros(len(h) - k + 1, _U))
            long = count >= k
            pick = np.repeat(at[:-1][long] - out_at[:-1][long], n[long]) + np.flatnonzero(np.repeat(long, n))
            out[np.repeat(long, n)] = full[pick]
        for size in range(1, k):
            here = np.flatnonzero(count == size)
            if len(here):
                out[out_at[here]] = sum((h[at[here] + j] * self.odd[j] for j in range(size)), np.full(len(here), size, _U))
        return mix(out), out_at
