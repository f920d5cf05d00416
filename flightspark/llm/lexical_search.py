"""Ranked lexical search over bags of words: equal bags are scored once.

Documents are reduced to the terms of the items: a bag lists the item terms that a document holds with their counts, in term order. The
length of a document enters a score only through an integer m, so documents with equal bag and equal m score alike
for every item. They are one class. A class is found by a hash and verified by the bag itself, which is part of the key;
of its members the `top` smallest ids are kept, more can never be among the first `top` of an item. Each class is scored once against
all items that share a term with it, every task keeps the best `top` classes of an item and expands their members by ascending id, up
to `top` rows an item.

The class of a document that holds a third of all rows costs `top` rows a task: the limit is applied before the shuffle. Items are taken in
blocks, so that the vocabulary in a task is bounded however many items there are; each block reads the documents once. Scores are
64-bit integers.

Defined results: a null or empty text has no term and is in no count but that of rows; an item without a term has no result; items are
judged row by row, items that share an id are one item with the terms of all its rows; equal scores stand by ascending doc_id, null
first; rows that share a doc_id are separate documents; a repeated item term counts as often as it stands; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightspark.llm.bytes_kit import buffers
from flightspark.session import checkpointed

TOP = 20
#: Term characters of items that are searched for at once.
BLOCK_CHARS = 4_000_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Sums of one round of scoring in a task.
ROUND = 1 << 18
#: A to Z become small; digits, letters and bytes of longer characters are parts of terms; the rest parts them.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    blanked = text.translate(TABLE)
    at = 0
    while at < len(blanked):
        cut = blanked.find(b" ", at + PIECE)
        end = len(blanked) if cut < 0 else cut
        yield blanked[at:end].split()
        at = end


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, off = buffers(column)
    for a, b in zip(off[:-1], off[1:]):
        yield data[a:b].tobytes()


class Vocabulary:
    """The terms of a block of items, numbered, with the items that hold each (compressed by term) and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        per_item: dict[int | None, Counter] = {}
        for item, text in items:
            bag = per_item.setdefault(item, Counter())
            for words in terms((text or "").encode()):
                bag.update(words)
        self.items = list(per_item)
        self.number = {t: i for i, t in enumerate(sorted(set().union(*per_item.values())))} if per_item else {}
        held: list[list[tuple[int, int]]] = [[] for _ in self.number]
        for i, item in enumerate(self.items):
            for t, n in per_item[item].items():
                held[self.number[t]].append((i, n))
        self.start = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
        self.item = np.array([i for h in held for i, _ in h], np.int64)
        self.times = np.array([n for h in held for _, n in h], np.int64)


def _bagger(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.number
        for batch in batches:
            lengths, bags = [], []
            for text in _texts(batch.column("text")):
                n, bag = 0, Counter()
                for words in terms(text):
                    n += len(words)
                    bag.update(map(number.get, words))
                bag.pop(None, None)
                lengths.append(n)
                bags.append(np.array(sorted(bag.items()), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = buffers(batch.column("bag"))
            np.add.at(held, np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2)[:, 0], 1)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(held[term])], names=["term", "df"])

    return run


class Best:
    """The best classes of each item that a task has met: higher scores first, then the smaller first member."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list[list[tuple[int, tuple, list]]] = [[] for _ in range(items)]
        self.floor = np.zeros(items, np.int64)  # no score below can enter

    def offer(self, scores: np.ndarray, members: list[list]) -> None:
        """Scores (classes x items) of some classes and their members, ascending."""
        hit = (scores > 0) & (scores >= self.floor)
        for item in np.flatnonzero(hit.any(axis=0)):
            rows = np.flatnonzero(hit[:, item])
            if len(rows) > self.top:  # the classes that tie with the last one stay, ids decide below
                limit = np.partition(scores[rows, item], -self.top)[-self.top]
                rows = rows[scores[rows, item] >= limit]
            mine = self.held[item] + [(int(scores[r, item]), members[r]) for r in rows]
            mine.sort(key=lambda c: (-c[0], c[1][0] is not None, c[1][0] or 0))
            self.held[item] = mine[: self.top]
            if len(mine) >= self.top:
                self.floor[item] = mine[self.top - 1][0]


def _scorer(vocabulary: Vocabulary, weight: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(vocabulary.items)
        best = Best(items, top)
        per_term = np.diff(vocabulary.start)
        step = max(1, ROUND // max(1, items))
        for batch in batches:
            m_all = batch.column("m").to_numpy(zero_copy_only=False)
            members = batch.column("members").to_pylist()
            data, off = buffers(batch.column("bag"))
            pairs = np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2).astype(np.int64)
            cut = off // 8
            for i in range(0, batch.num_rows, step):
                j = min(i + step, batch.num_rows)
                row = np.repeat(np.arange(j - i), np.diff(cut[i: j + 1]))
                term, tf = pairs[cut[i]: cut[j]].T
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m_all[i:j][row]))
                sums = np.zeros((j - i) * items, np.int64)
                # Each (class, term) meets the items that hold the term; some at a time.
                meets = np.concatenate([[0], np.cumsum(per_term[term])])
                a = 0
                while a < len(term):
                    b = max(a + 1, int(np.searchsorted(meets, meets[a] + ROUND, "right")) - 1)
                    k = per_term[term[a:b]]
                    at = np.arange(k.sum()) + np.repeat(vocabulary.start[term[a:b]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k)
                    np.add.at(sums, np.repeat(row[a:b], k) * items + vocabulary.item[at], np.repeat(part[a:b], k) * vocabulary.times[at])
                    a = b
                best.offer(sums.reshape(j - i, items), members[i:j])
        # Of the members of the classes that a task has kept, no more than the first `top` can be among the first of an item.
        out = [(vocabulary.items[i], score, doc) for i, mine in enumerate(best.held)
               for score, doc in sorted(((s, d) for s, ids in mine for d in ids), key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[:top]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["item_id", "score", "doc_id"])

    return run


def classes(bags: DataFrame, top: int = TOP) -> DataFrame:
    """(m, bag, members): one row per class of equal bag and m; its `top` smallest ids, ascending, nulls first.

    The hash deals and sorts the rows; a class is what agrees in bag and m as well, so a collision of hashes joins nothing.
    """
    hashed = bags.withColumn("h", F.xxhash64("bag", "m"))
    key = ["h", "m", "bag"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    # Filtering a row number on a limit lets Spark drop rows beyond it before the shuffle.
    first = hashed.withColumn("nth", nth).filter(F.col("nth") <= top)
    held = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("ids"))
    return held.select("m", "bag", F.col("ids.doc_id").alias("members"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in order of their id, in lists of about BLOCK_CHARS characters; the driver holds one list at a time."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        if size + len(r["text"] or "") > BLOCK_CHARS and block and block[-1][0] != r["item_id"]:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(items):
        vocabulary = Vocabulary(block)
        bags = checkpointed(rows.mapInArrow(_bagger(vocabulary), "doc_id long, n long, bag binary"))
        docs_with, length = bags.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not length or not vocabulary.number:
            continue
        df = np.zeros(len(vocabulary.number), np.int64)
        frequencies = bags.select("bag").mapInArrow(_document_frequencies(len(df)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        # One row for each term of the block at most.
        for r in frequencies.toLocalIterator():
            df[r["term"]] = r["df"]
        weight = np.floor(1000 * np.log((2.0 * docs_with + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
        held = bags.filter(F.length("bag") > 0)
        m = F.lit(75).cast("long") + F.expr(f"(25 * n * {docs_with}L) div {length}L")
        best = classes(held.select("doc_id", "bag", m.alias("m")), top).mapInArrow(_scorer(vocabulary, weight, top), "item_id long, score long, doc_id long")
        part = checkpointed(best)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

