"""Winnowed seeds and the stretches of windows that belong to them, for words or bytes.

In every window of `length` symbols the least k-gram is its seed. Equal windows have equal seeds at equal places, so two
documents can share a window only where they share a seed. Neighbouring windows with one seed form a *stretch*; windows that
cannot be shared are told from stretches alone and are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from flightspark.llm.bytes_kit import Rolling, U64, Words, mix, slices

_LOW = U64(0xFFFFFFFF)


@dataclass(frozen=True)
class Unit:
    """What is compared: words or bytes, how many make a window, and how many make a seed."""

    words: bool
    length: int
    seed: int


class Symbols:
    """The symbols of a slice as integers, with the bounds of its rows."""

    def __init__(self, unit: Unit, data: np.ndarray, off: np.ndarray):
        self.unit = unit
        if unit.words:
            self.words = Words(data, off)
            self.values, self.first = self.words.hashes(), self.words.first
        else:
            self.values, self.first = data + U64(1), off
        self.roll = Rolling(self.values, 0)
        self._other = None

    @property
    def other(self) -> Rolling:
        if self._other is None:
            self._other = Rolling(mix(self.values + U64(77)), 1)
        return self._other

    def prints(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit fingerprints of each stretch."""
        return self.roll.of(start, end), self.other.of(start, end)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    if n < width:
        return np.zeros(0, keys.dtype)
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def stretches(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, seed hash, seed place) of every stretch in a slice; windows never leave a row."""
    length, k = s.unit.length, s.unit.seed
    n = len(s.values)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64), np.zeros(0, np.int64))
    grams = s.roll.grams(k)
    # Ties go to the leftmost gram, which depends on the window alone.
    least = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=U64), length - k + 1)
    at = (least & _LOW).astype(np.int64)
    whole = np.ones(n - length + 1, bool)
    for edge in s.first[1:-1]:
        whole[max(0, edge - length + 1): edge] = False
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    new &= whole
    first = np.flatnonzero(new)
    stop = np.flatnonzero(~whole)
    after = np.append(stop, len(at))[np.searchsorted(stop, first)]
    end = np.minimum(np.append(first[1:], len(at)), after)
    row = np.searchsorted(s.first, first, "right") - 1
    return row, first, end - first, grams[at[first]], at[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def seed_rows(unit: Unit, keys: list[str], full: bool):
    """mapInArrow body: (keys, text) to stretches. Without `full` only the seed is returned.

    `at` is the first window, `n` their number, `ahead` the symbols of the stretch before its seed, fp1 and fp2 its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in slices(batch.column("text")):
                s = Symbols(unit, data, off)
                row, first, count, seed, place = stretches(s)
                if not len(row):
                    continue
                own = batch.select(keys).take(pa.array(row + i)).columns
                cols = [*own, _signed(seed)]
                names = [*keys, "seed"]
                if full:
                    a, b = s.prints(first, first + count + unit.length - 1)
                    cols += [pa.array((first - s.first[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((place - first).astype(np.int32)),
                             _signed(a), _signed(b)]
                    names += ["at", "n", "ahead", "fp1", "fp2"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def window_rows(unit: Unit, keys: list[str]):
    """mapInArrow body: (keys, text, looks: array of (at, n)) to one row per listed window with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looks = batch.column("looks")
            for i, j, data, off in slices(batch.column("text")):
                s = Symbols(unit, data, off)
                part = looks.slice(i, j - i)
                flat = part.flatten()
                per = np.diff(np.asarray(part.offsets, dtype=np.int64))
                row = np.repeat(np.arange(j - i), per)
                start = flat.field("at").to_numpy().astype(np.int64) + s.first[row]
                count = flat.field("n").to_numpy().astype(np.int64)
                total = int(count.sum())
                if not total:
                    continue
                base = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)
                rows = np.repeat(row, count)
                a, b = s.prints(base, base + unit.length)
                own = batch.select(keys).take(pa.array(rows + i)).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array((base - s.first[rows]).astype(np.int32)), _signed(a), _signed(b)],
                                                 names=[*keys, "at", "fp1", "fp2"])

    return run
