"""Importance resampling towards a target: documents are drawn by how much more their word runs belong to the target than to the corpus.

Words come from bytes: a table of 256 entries lower-cases A-Z and blanks every other ASCII byte that is no digit or letter, and
`bytes.split` cuts what is left, so letters beyond ASCII stay in words whole. A feature is a run of one to `ORDER` words joined by a
space; its bucket is its CRC-32 modulo `BUCKETS`. The checksum of a run goes on from that of the run without its last word, so
no run is put together as a string. Counters take up the buckets of a task and only their at most `BUCKETS` sums leave it; the
gains of the buckets (one integer each, a table of fixed size) go back to all tasks, which read the texts a second time.

The draw adds Gumbel noise made from a hash of doc_id to the mean gain and keeps the largest sums, which is a draw without
replacement with probabilities in proportion to exp(weight). Ranks come from a range sort with one count per chunk.

Defined results: a null or empty text has no features, weight 0 and is never drawn, as any text of less than `min_words` words;
ties go to the smaller doc_id, nulls first, and then to fewer features; rows that share an id are separate texts with the same
noise; a null doc_id has the noise of the text `7:`; an empty target or corpus counts as zero of everything; other columns are not
read. A long text is split piece by piece, so memory does not grow with it beyond its bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.llm.bytes_kit import buffers
from flightspark.operators.scale import ranked
from flightspark.session import checkpointed

ORDER = 2
BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
#: Bytes of a text that are split at once.
PIECE = 1 << 18
#: A to Z become small; digits, small letters and bytes of longer characters stay; the rest becomes blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(blanked: bytes) -> Iterator[bytes]:
    """Stretches of about PIECE bytes that end at a blank."""
    at = 0
    while at < len(blanked):
        cut = blanked.find(b" ", at + PIECE)
        end = len(blanked) if cut < 0 else cut
        yield blanked[at:end]
        at = end


def checksums(text: bytes, order: int = ORDER) -> Iterator[tuple[int, list[int]]]:
    """(words, CRC-32 of every run that ends in them), piece by piece."""
    open_runs: list[int] = []  # checksums of the runs that end at the last word, by length
    for piece in _pieces(text.translate(TABLE)):
        words = piece.split()
        if not words:
            continue
        # A run of n words is a blank and its last word after the run of n - 1 words that ends one word earlier.
        found = shorter = list(map(zlib.crc32, words))
        blank_first = [b" " + w for w in words]
        last = [shorter[-1]]
        for n in range(1, order):
            seeds = open_runs[n - 1:n] + shorter[:-1]
            longer = list(map(zlib.crc32, blank_first[len(words) - len(seeds):], seeds))
            found = found + longer
            if not longer:
                break
            last.append(longer[-1])
            shorter = longer
        open_runs = last
        yield len(words), found


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, off = buffers(column)
    for a, b in zip(off[:-1], off[1:]):
        yield data[a:b].tobytes()


def _counter(buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in _texts(batch.column("text")):
                for _, found in checksums(text, order):
                    total.update((np.array(found, np.int64) % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(bucket, n) over all rows of `texts`; a task sends at most one row a bucket."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(buckets, order), "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """The gain of every bucket, in order: floor(1000 * ln of its share in the target over its share in the corpus), both plus one."""
    s = bucket_counts(docs, buckets, order).select("bucket", F.col("n").alias("s"))
    t = bucket_counts(target, buckets, order).select("bucket", F.col("n").alias("t"))
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    # A table of one row a bucket: its size is fixed whatever the corpus, also on the driver.
    rows = checkpointed(every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]))
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    num = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    den = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    return [r["gain"] for r in rows.select("bucket", F.floor(1000 * F.log(num / den)).cast("long").alias("gain")).orderBy("bucket").collect()]


def _weigher(gain: list[int], order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            words, features, weight = [], [], []
            for text in _texts(batch.column("text")):
                n = m = total = 0
                for k, found in checksums(text, order):
                    n += k
                    m += len(found)
                    total += int(table[np.array(found, np.int64) % len(table)].sum())
                words.append(n)
                features.append(m)
                weight.append(total // m if m else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (words, features, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: list[int], order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of the features of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_weigher(gain, order), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for an id in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per row of `docs`; `rank` is null where a row is not drawn.

    Of the N rows with `min_words` words or more, floor(percent * N / 100) are drawn.
    """
    scored = weights(docs, gains(docs, target, buckets, order), order)
    scored = checkpointed(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    n = scored.filter(able).count()
    order_by = scored.filter(able).withColumn("_down", -F.col("score"))
    # Rows that tie in all of these are equal in every column of the result.
    drawn = ranked(order_by, [], ["_down", "doc_id", "n_features", "n_words", "weight"]).drop("_down").withColumn("rank", F.col("rank") + 1)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
