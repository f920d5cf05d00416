"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

An item of m characters that lies in a document with at most e edits leaves at least m - q + 1 - q * e of its q-grams there,
all on diagonals (document position minus item position) that differ by at most e. Shared q-grams are counted in diagonal
bands two budgets wide that overlap by one, so that every such match lies in one band whole. Bands that reach the count are
aligned within the band, and only alignments inside the budget are reported.

Documents are read once and never shuffled. The items are the stated query set: they go to the tasks in blocks of bounded
size, each block against all documents.

Characters are folded to lower case one by one and runs of white space count as one space. Defined results: a null text holds
nothing; an item that is null or has fewer than q characters is never found; items with equal texts are each reported; a
document with a null or repeated id is reported under that id as often as it comes; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightspark.llm.bytes_kit import WIDE_SLICE, Rolling, U64, slices

Q = 8
BUDGET = 0.1
#: Characters of items that are sent to the tasks at once.
BLOCK_CHARS = 4_000_000
MATCH = "doc_id long, item_id long, edits int, times int, start int, end int"
_NONE = np.uint32(0xFFFFFFFF)
_BITS = 22


def _fold_table() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000:
            x = chr(c).lower()
            out[c] = 32 if chr(c).isspace() else ord(x) if len(x) == 1 else c
    return out


def _folded(raw: bytes, edges: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters without repeated spaces, their places among the row's characters, row bounds, first character of rows.

    `edges` are byte offsets of the rows in `raw`.
    """
    data = np.frombuffer(raw, np.uint8)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    low = chars < (1 << 16)
    chars = np.where(low, fold[np.where(low, chars, 0)], chars)
    bound = heads[edges]
    space = chars == 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bound[bound < len(chars)]] = True
    at = np.flatnonzero(keep)
    return chars[at], at, np.searchsorted(at, bound), bound


def budget(m: int, q: int = Q, share: float = BUDGET) -> int:
    """Edits allowed in an item of m characters: the share of its length, as far as the lemma still asks for a common q-gram."""
    return max(0, min(int(m * share), (m - q) // q))


class Index:
    """The q-grams of a block of items, by fingerprint, with the places where they stand."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float):
        self.q, self.fold = q, _fold_table()
        self.ids, self.texts, prints, owner, place = [], [], [], [], []
        for item_id, text in items:
            raw = (text or "").encode()
            chars = _folded(raw, np.array([0, len(raw)]), self.fold)[0]
            a, b = (1 if len(chars) and chars[0] == 32 else 0), len(chars) - (1 if len(chars) and chars[-1] == 32 else 0)
            chars = chars[a:b]
            if len(chars) >= q:
                g = Rolling(chars.astype(U64) + U64(1)).grams(q)
                prints.append(g)
                owner.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
                self.ids.append(item_id)
                self.texts.append(chars)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(int(m), q, share) for m in self.size], np.int64)
        self.least = self.size - q + 1 - q * self.edits
        if not self.ids:
            return
        prints, owner, place = (np.concatenate(x) for x in (prints, owner, place))
        order = np.argsort(prints, kind="stable")
        self.prints, self.first = np.unique(prints[order], return_index=True)
        self.first = np.append(self.first, len(prints))
        self.owner, self.place = owner[order], place[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.prints >> U64(64 - _BITS)).astype(np.int64)] = True

    def bands(self, chars: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, band) of the bands that share enough q-grams."""
        none = (np.zeros(0, np.int64),) * 3
        g = Rolling(chars.astype(U64) + U64(1)).grams(self.q)
        at = np.flatnonzero(self.maybe[(g >> U64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return none
        where = np.minimum(np.searchsorted(self.prints, g[at]), len(self.prints) - 1)
        hit = self.prints[where] == g[at]
        at, where = at[hit], where[hit]
        row = np.searchsorted(bound, at, "right") - 1
        inside = at + self.q <= bound[row + 1]
        at, where, row = at[inside], where[inside], row[inside]
        many = self.first[where + 1] - self.first[where]
        n = int(many.sum())
        if not n:
            return none
        entry = np.repeat(self.first[where] - (np.cumsum(many) - many), many) + np.arange(n)
        item, place = self.owner[entry], self.place[entry]
        row, at = np.repeat(row, many), np.repeat(at, many)
        step = self.edits[item] + 1
        band = (at - bound[row] - place + int(self.size.max())) // step
        row, item, band, place = (np.concatenate([x, y]) for x, y in ((row, row), (item, item), (band, band - 1), (place, place)))
        # Enough shared q-grams at all, then enough different ones.
        order = np.lexsort((band, item, row))
        row, item, band, place = row[order], item[order], band[order], place[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(row)))
        picked = []
        for h, c in zip(head[count >= self.least[item[head]]], count[count >= self.least[item[head]]]):
            if len(np.unique(place[h: h + c])) >= self.least[item[h]]:
                picked.append(h)
        picked = np.array(picked, np.int64)
        return row[picked], item[picked], band[picked]


def _align(pattern: np.ndarray, size: np.ndarray, text: np.ndarray, width: int, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each padded pattern within its band and the band column where the alignment ends.

    Column c of row i stands for text position i + c. Unless anchored, an alignment may begin in any column.
    """
    n, column = len(pattern), np.arange(width, dtype=np.int32)
    d = np.tile(column if anchored else np.zeros(width, np.int32), (n, 1))
    best, end = np.full(n, 1 << 20, np.int32), np.zeros(n, np.int64)
    for i in range(1, int(size.max()) + 1):
        t = d + (pattern[:, i - 1: i] != text[:, i - 1: i - 1 + width])
        t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(t - column, axis=1) + column
        done = np.flatnonzero(size == i)
        if len(done):
            end[done] = d[done].argmin(axis=1)
            best[done] = d[done, end[done]]
    return best, end


def _verify(index: Index, chars: np.ndarray, bound: np.ndarray, row, item, band, batch: int = 512):
    """(row, item, edits, start, end) for the bands whose alignment keeps the budget; positions in folded characters."""
    out = []
    for lo in range(0, len(row), batch):
        r, t, b = row[lo: lo + batch], item[lo: lo + batch], band[lo: lo + batch]
        e, m = index.edits[t], index.size[t]
        width = int(4 * e.max() + 2)
        deep = int(m.max())
        pattern = np.full((len(r), deep), _NONE - np.uint32(1), np.uint32)
        for k, x in enumerate(t):
            pattern[k, : m[k]] = index.texts[x]
        begin = bound[r] + b * (e + 1) - int(index.size.max()) - e
        at = begin[:, None] + np.arange(deep + width)
        inside = (at >= bound[r][:, None]) & (at < bound[r + 1][:, None])
        text = np.where(inside, chars[np.clip(at, 0, len(chars) - 1)], _NONE)
        edits, column = _align(pattern, m, text, width, False)
        good = np.flatnonzero(edits <= e)
        if not len(good):
            continue
        r, t, m, edits, begin, e = r[good], t[good], m[good], edits[good], begin[good], e[good]
        stop = begin + m + column[good]
        back = np.full((len(good), deep), _NONE - np.uint32(1), np.uint32)
        for k, x in enumerate(t):
            back[k, : m[k]] = index.texts[x][::-1]
        half = int(e.max())
        # Read backwards from the end; the column is shifted so that a shorter text than the item fits too.
        at = stop[:, None] - 1 - (np.arange(deep + 2 * half + 1) - half)
        inside = (at >= bound[r][:, None]) & (at < stop[:, None])
        text = np.where(inside, chars[np.clip(at, 0, len(chars) - 1)], _NONE)
        start = stop - _reach(back, m, text, half, edits)
        out.append((r, t, edits, start, stop))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _reach(pattern: np.ndarray, size: np.ndarray, text: np.ndarray, half: int, edits: np.ndarray) -> np.ndarray:
    """Length of the text that an alignment beginning at its first character takes with the given edits."""
    width = 2 * half + 1
    column = np.arange(width, dtype=np.int32)
    d = np.tile(np.where(column >= half, column - half, 1 << 20).astype(np.int32), (len(pattern), 1))
    taken = np.zeros(len(pattern), np.int64)
    for i in range(1, int(size.max()) + 1):
        t = d + (pattern[:, i - 1: i] != text[:, i - 1: i - 1 + width])
        t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(t - column, axis=1) + column
        for k in np.flatnonzero(size == i):
            taken[k] = i + int(np.flatnonzero(d[k] <= max(edits[k], d[k].min()))[0]) - half
    return taken


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), WIDE_SLICE):
                if not len(data) or not index.ids:
                    continue
                chars, place, bound, origin = _folded(data.tobytes(), off, index.fold)
                row, item, band = index.bands(chars, bound)
                if not len(row):
                    continue
                row, item, edits, start, stop = _verify(index, chars, bound, row, item, band)
                best: dict[tuple[int, int], list] = {}
                for r, t, e, a, b in zip(row.tolist(), item.tolist(), edits.tolist(), start.tolist(), stop.tolist()):
                    a, b = int(place[a] - origin[r]), int(place[b - 1] - origin[r]) + 1
                    best.setdefault((r, t), []).append((e, a, b))
                rows = []
                for (r, t), found in sorted(best.items()):
                    found.sort()
                    apart: list[tuple[int, int, int]] = []
                    for f in found:
                        if all(f[2] <= g[1] or f[1] >= g[2] for g in apart):
                            apart.append(f)
                    rows.append((r + i, index.ids[t], found[0][0], len(apart), found[0][1], found[0][2]))
                if rows:
                    c = list(zip(*rows))
                    own = batch.column("doc_id").take(pa.array(c[0]))
                    yield pa.RecordBatch.from_arrays([own, pa.array(c[1], pa.int64()), *[pa.array(x, pa.int32()) for x in c[2:]]],
                                                     names=[x.split()[0] for x in MATCH.split(", ")])

    return find


def matches(docs: DataFrame, items: DataFrame, *, q: int = Q, share: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, times, start, end): each item that a document holds within its edit budget.

    `start` and `end` count characters of the text; `times` counts occurrences that do not overlap.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        found = texts.mapInArrow(_finder(spark.sparkContext.broadcast(Index(rows, q, share))), MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that hold an item; rows with a null id are judged by their text alone and kept if clean."""
    return docs.filter(~holds(docs.sparkSession, items, **options)(F.col("text").cast("string")))


def holds(spark, items: DataFrame, *, q: int = Q, share: float = BUDGET, block_chars: int = BLOCK_CHARS):
    """A column function telling whether a text holds any item; it goes over the blocks of items in turn."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    shared = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared.append(spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part.collect()], q, share)))

    def leaks(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for one in shared:
            find = _finder(one)
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], names=["doc_id", "text"])
            for found in find([batch]):
                out[found.column("doc_id").to_numpy()] = True
        return pa.array(out)

    return F.arrow_udf(leaks, "boolean")
