"""Vectorised helpers over the UTF-8 bytes of an Arrow string column, used inside Spark tasks.

A column is handled in slices of a quarter of a megabyte to one, so memory stays small however many rows a batch has; only a single
longer text makes a longer slice. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 18
#: For work with a fixed cost a slice, such as rounds or steps that go over all rows of the slice at once.
WIDE_SLICE = 1 << 20
#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size + 1, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept for the next call in sizes of powers of two."""
    return _powers(which, max(1 << 16, 1 << int(n).bit_length()))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """`wanted`, with underscores added until no column has that name (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Fingerprints of any stretch of a sequence of integers from one prefix sum."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        self.up, self.down = powers(n, which)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols.astype(U64) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m] + U64(k))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(wide)
    if col.null_count:
        col = pc.fill_null(col, b"" if wide == pa.large_binary() else "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of about `size` bytes."""
    data, off = buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n, i + 4096)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-word) array over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Words:
    """Word bounds of a slice: start and end byte, row of each word, and first word of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        self.data, self.off = data, off
        ink = np.zeros(n + 2, bool)
        ink[1:-1] = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        self.ink = ink[1:-1]
        self.start = np.flatnonzero(self.ink & (~ink[:-2] | edge[:-1]))
        self.end = np.flatnonzero(self.ink & (~ink[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, roll: Rolling | None = None) -> np.ndarray:
        return (roll or Rolling(self.data + U64(1))).of(self.start, self.end)

    def whole(self, k: int) -> np.ndarray:
        """For each k-word window of the slice, whether it lies in one row."""
        m = len(self.start) - k + 1
        return self.row[:m] == self.row[k - 1:] if m > 0 else np.zeros(0, bool)


def covered(hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Positions 0..n-1 covered by windows of length k that start where `hit` is set."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return np.cumsum(step[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of set flags."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
