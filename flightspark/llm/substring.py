"""Removal of word passages that an earlier document already has.

Seed and extend: documents meet on winnowed seeds. A stretch of windows around a seed whose whole content stands in a document
with a smaller id is removed at once; where contents around a shared seed differ, the windows of one copy of each content are
grouped by fingerprint over all documents. Nothing is extended to the left or right of a seed. Runs of removed windows are the maximal repeats over the length threshold.

A seed shared by very many documents costs one row per occurrence and one per differing content, never a pair; counts and
minima are combined before each shuffle.

Defined results: null and empty texts have no words and stay; a null doc_id neither loses words nor makes others lose any;
repeated rows are treated alike (a document is never its own predecessor); other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightspark.llm.bytes_kit import Words, free_name, runs, slices
from flightspark.llm.seeds import Unit, seed_rows, window_rows
from flightspark.session import checkpointed

WORDS = Unit(words=True, length=50, seed=10)
KEYS = ["doc_id", "th"]
_KEY_TYPES = "doc_id long, th long"


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, th, text): th tells rows apart that share an id."""
    body = F.col(text).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))


def repeated_windows(docs: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """(doc_id, th, spans): stretches of windows, as (at, n), that start in a document with a smaller id too."""
    keyed = _keyed(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    narrow = keyed.mapInArrow(seed_rows(unit, ["doc_id"], False), "doc_id long, seed long")
    shared = narrow.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("seed")
    # Written, so that the join with it can be split where a seed is hot; so are the other small sides below.
    shared = checkpointed(shared)
    full = keyed.mapInArrow(seed_rows(unit, KEYS, True), f"{_KEY_TYPES}, seed long, at int, n int, ahead int, fp1 long, fp2 long")
    found = checkpointed(full.join(shared, "seed"))

    contents = checkpointed(found.groupBy("seed", "fp1", "fp2").agg(F.min("doc_id").alias("lo")))
    varied = checkpointed(contents.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("seed", F.lit(True).alias("varied")))
    contents = checkpointed(contents.join(varied, "seed", "left"))
    told = found.join(contents, ["seed", "fp1", "fp2"])
    told = checkpointed(told.select(*KEYS, "at", "n", (F.col("lo") < F.col("doc_id")).alias("whole"), F.col("varied").isNotNull().alias("varied")))

    looks = (told.filter("varied AND NOT whole").groupBy(*KEYS).agg(F.collect_list(F.struct("at", "n")).alias("looks")))
    texts = keyed.join(looks, KEYS)
    windows = checkpointed(texts.select(*KEYS, "text", "looks").mapInArrow(window_rows(unit, KEYS), f"{_KEY_TYPES}, at int, fp1 long, fp2 long"))
    firsts = checkpointed(windows.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"))
    later = windows.join(firsts, ["fp1", "fp2"]).filter(F.col("doc_id") > F.col("lo")).select(*KEYS, "at", F.lit(1).alias("n"))
    spans = told.filter("whole").select(*KEYS, "at", "n").unionByName(later)
    return spans.groupBy(*KEYS).agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _marked(spans: pa.ListArray, first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Symbols of the slice that lie in a listed stretch of windows."""
    step = np.zeros(n + 1, np.int64)
    flat = spans.flatten()
    if len(flat):
        row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets, dtype=np.int64)))
        start = flat.field("at").to_numpy().astype(np.int64) + first[row]
        np.add.at(step, start, 1)
        np.add.at(step, start + flat.field("n").to_numpy().astype(np.int64) + length - 1, -1)
    return np.cumsum(step[:n]) > 0


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())])


def _cutter(unit: Unit):
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        total, gone, digests, texts = [], [], [], []
        for i, j, data, off in slices(text):
            w = Words(data, off)
            drop = _marked(spans.slice(i, j - i), w.first, unit.length, len(w))
            raw = data.tobytes()
            for r in range(j - i):
                a, b = w.first[r], w.first[r + 1]
                own = raw[off[r]: off[r + 1]]
                lost = drop[a:b]
                n = int(lost.sum())
                total.append(b - a)
                gone.append(n)
                if n:
                    keep = []
                    starts, ends = w.start[a:b] - off[r], w.end[a:b] - off[r]
                    done = 0
                    for x, y in zip(*runs(lost)):
                        keep.append(own[done: starts[x]])
                        done = int(starts[y]) if y < len(starts) else int(ends[y - 1])
                    keep.append(own[done:])
                    own = b"".join(keep)
                digests.append(hashlib.sha256(b" ".join(own.split())).hexdigest())
                texts.append(own.decode() if n else None)
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                                          fields=[pa.field(f.name, t) for f, t in zip(_CUT.fields, (pa.int64(), pa.int64(), pa.string(), pa.string()))])

    return F.arrow_udf(cut, _CUT)


def remove_repeats(docs: DataFrame, unit: Unit = WORDS, text: str = "text", name: str = "_cut") -> DataFrame:
    """`docs` with a struct column `name`: n_words, n_removed, kept_sha256, and the kept text where words were removed."""
    spans = repeated_windows(docs if text == "text" else docs.withColumn("text", F.col(text)), unit)
    k, h, s = (free_name(docs.columns, c) for c in ("_k", "_h", "_spans"))
    spans = spans.select(F.col("doc_id").alias(k), F.col("th").alias(h), F.col("spans").alias(s))
    out = docs.join(spans, (F.col("doc_id").cast("long") == F.col(k)) & (F.xxhash64(F.col(text).cast("string")) == F.col(h)), "left")
    none = F.array().cast("array<struct<at: int, n: int>>")
    return out.withColumn(name, _cutter(unit)(F.col(text).cast("string"), F.coalesce(s, none))).drop(k, h, s)


def dedup_text(docs: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """`docs` with repeated passages cut out of `text`; texts without one stay byte for byte, columns as they came."""
    name = free_name(docs.columns, "_cut")
    cut = remove_repeats(docs, unit, name=name)
    cols = [F.coalesce(F.col(f"{name}.text"), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        body = F.coalesce(F.col(f"{name}.text"), F.col("text"))
        cols = [F.when(F.col(f"{name}.n_removed") > 0, F.length(body).cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else x
                for c, x in zip(docs.columns, cols)]
    return cut.select(*cols)
