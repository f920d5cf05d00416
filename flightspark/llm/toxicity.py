"""Toxicity by multiple-instance learning: documents are bags of sentences, labels are known for bags only.

Each sentence gets the probability 1 / (1 + exp(-(bias + sum of the weights of its words and of their beginnings))). A document
is toxic if any sentence is: its score is the noisy-or 1 - prod(1 - p). The weights of hashed words and beginnings are trained
through the noisy-or from document labels on a bounded sample of labelled rows; then all rows are scored, and offending sentences are found by their own probabilities.

Words are folded to lower case (ASCII) and stripped of ASCII punctuation. A sentence ends with . ! or ? at a word's end or with
a line feed. Only the text enters a score.

Defined results: null and empty texts have no sentence and get the share of toxic rows in the training sample; with no labelled
rows of a class every score is that share (0 with no rows at all); ids may repeat or be null, a null id is never used for
training; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.llm.bytes_kit import Rolling, U64, Words, mix, slices

BITS = 18
#: Beginnings of words, in bytes, that are features besides the words.
STEMS = (4, 5, 6)
#: Evidence that a feature needs to get a weight: twice the log likelihood ratio of its share of toxic training documents.
LEAST_EVIDENCE = 12.0
#: Labelled rows used for training at most, those with the least hashes of each class.
SAMPLE_ROWS = 6_000
#: Characters of the sample at most, for either class; rows are taken whole, those with the least hashes first.
SAMPLE_CHARS = 10_000_000
SCORED = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, n_offending int, worst_at int, worst_score double"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


@dataclass
class Sentences:
    feature: np.ndarray  # hashed words and beginnings
    sentence: np.ndarray  # sentence of each of them, in the slice
    row: np.ndarray  # row of each sentence
    start: np.ndarray  # first and end byte of each sentence, from its row's beginning
    end: np.ndarray


def sentences(data: np.ndarray, off: np.ndarray) -> Sentences:
    folded = np.where(_PUNCT[data], np.uint8(32), _LOWER[data])
    plain = Words(folded, off)
    roll = Rolling(folded + U64(1))
    cuts = [plain.end, *(np.minimum(plain.end, plain.start + k) for k in STEMS)]
    feature = np.concatenate([mix(roll.of(plain.start, e) + U64(k)) >> U64(64 - BITS) for k, e in enumerate(cuts)]).astype(np.int32)
    w = Words(data, off)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    new = np.ones(len(w), bool)
    if len(w) > 1:
        new[1:] = _STOP[data[w.end[:-1] - 1]] | (breaks[w.start[1:]] != breaks[w.start[:-1]]) | (w.row[1:] != w.row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(w)) - 1 if len(head) else head
    row = w.row[head]
    sentence = np.tile((np.searchsorted(w.start[head], plain.start, "right") - 1).astype(np.int32), len(cuts))
    return Sentences(feature, sentence, row, w.start[head] - off[row], w.end[tail] - off[row])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def _chances(model: Model, s: Sentences) -> np.ndarray:
    z = model.bias + np.bincount(s.sentence, weights=model.weights[s.feature], minlength=len(s.row))
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def evidence(toxic: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """By feature: twice the log likelihood ratio that it stands in toxic rows more often than rows are toxic, else zero.

    `toxic` and `other` count the rows of either class that have the feature; `share` of all rows are toxic."""
    both = np.maximum(toxic + other, 1)
    term = lambda n, p: n * np.log(np.maximum(n, 1) / (both * p))
    return np.where(toxic > both * share, 2 * (term(toxic, share) + term(other, 1 - share)), 0.0)


def train(texts: pa.Array, labels: np.ndarray, *, rounds: int = 200, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Adam on the noisy-or likelihood; every step sees the whole sample."""
    prior = float(labels.mean()) if len(labels) else 0.0
    weights, bias = np.zeros(1 << BITS), -6.0
    if not 0 < prior < 1:
        return Model(weights, bias, prior)
    # First the features worth a weight, then only those, so that memory holds the sample's texts and little more.
    seen = np.zeros((2, 1 << BITS))
    for i, _, data, off in slices(texts):
        s = sentences(data, off)
        pairs = np.unique(s.row[s.sentence].astype(np.int64) << BITS | s.feature)
        of_toxic = labels[(pairs >> BITS) + i] == 1
        for k in (0, 1):
            seen[k] += np.bincount(pairs[of_toxic == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    used = np.flatnonzero(evidence(seen[1], seen[0], prior) >= LEAST_EVIDENCE)
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    sent = 0
    feature, sentence, row = [], [], []
    for i, _, data, off in slices(texts):
        s = sentences(data, off)
        kept = number[s.feature] >= 0
        feature.append(number[s.feature[kept]])
        sentence.append(s.sentence[kept] + sent)
        row.append(s.row + i)
        sent += len(s.row)
    feature, sentence, row = np.concatenate(feature), np.concatenate(sentence), np.concatenate(row)
    w, b = np.zeros(len(used)), bias
    m1, m2, n1, n2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    n = len(labels)
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(sentence, weights=w[feature], minlength=sent), -30, 30)
        p = 1.0 / (1.0 + np.exp(-z))
        safe = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)  # log of no sentence offending
        none = np.exp(safe)
        doc = np.clip(1.0 - none, 1e-9, 1.0)
        # d(log likelihood)/dz of a sentence is p * none / doc for toxic documents and -p for others.
        pull = np.where(labels == 1, none / doc, -1.0)[row] * p / n
        g = np.bincount(feature, weights=pull[sentence], minlength=len(used)) - decay * w
        gb = pull.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        n1, n2 = 0.9 * n1 + 0.1 * gb, 0.99 * n2 + 0.01 * gb * gb
        w = w + rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-6)
        b = b + rate * (n1 / (1 - 0.9 ** t)) / (np.sqrt(n2 / (1 - 0.99 ** t)) + 1e-6)
    weights[used] = w
    return Model(weights, float(b), prior)


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled rows that are not held out and `chars` characters for either class, half of the
    rows of either class where there are as many."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    marks = marks.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = marks.filter("label = 1").orderBy(*order).limit(rows // 2).unionByName(marks.filter("label = 0").orderBy(*order).limit(rows // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).dropDuplicates(["text", "label"])
    # Of the bounded number of rows of a class, in their order, each is taken that fits into the characters left: a long text costs none but itself.
    lengths = F.array_sort(F.collect_list(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.length("text").cast("long").alias("n"))))
    start = F.struct(F.lit(chars).cast("long").alias("left"), F.array().cast("array<bigint>").alias("ids"))
    taken = F.aggregate("rows", start, lambda s, r: F.when(r["n"] <= s["left"], F.struct((s["left"] - r["n"]).alias("left"), F.array_append(s["ids"], r["doc_id"]).alias("ids"))).otherwise(s))
    kept = found.groupBy("label").agg(lengths.alias("rows")).select("label", F.explode(taken["ids"]).alias("doc_id"))
    return found.join(kept, ["label", "doc_id"]).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", **options) -> Model:
    """Trains on the driver: the sample is bounded by SAMPLE_ROWS and SAMPLE_CHARS whatever the table's size."""
    rows = sample(docs, labels, target).toArrow().sort_by("doc_id")
    text = rows.column("text").combine_chunks()
    return train(text, rows.column("label").to_numpy().astype(int), **options)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            out = [[] for _ in range(5)]
            for i, j, data, off in slices(batch.column("text")):
                n = j - i
                s = sentences(data, off)
                p = _chances(model, s) if 0 < model.prior < 1 else np.full(len(s.row), 0.0)
                none = np.exp(np.bincount(s.row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
                count = np.bincount(s.row, minlength=n)
                score = np.where((count > 0) & (0 < model.prior < 1), 1.0 - none, model.prior)
                worst_at, worst = np.full(n, -1), np.zeros(n)
                order = np.lexsort((np.arange(len(p)), -p, s.row))
                lead, at = np.unique(s.row[order], return_index=True)
                worst_at[lead], worst[lead] = s.start[order[at]], p[order[at]]
                for x, y in zip(out, (score, count, np.bincount(s.row, weights=p >= 0.5, minlength=n).astype(int), worst_at, worst)):
                    x.append(y)
            score, count, bad, at, worst = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(bad.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(worst, pa.float64())],
                names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row: score and prediction, how many sentences offend, and where the worst begins (byte; -1 for none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), SCORED)


def _locator(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for i, _, data, off in slices(batch.column("text")):
                s = sentences(data, off)
                p = _chances(model, s)
                bad = np.flatnonzero(p >= least)
                texts = [data[off[r] + a: off[r] + b].tobytes().decode() for r, a, b in zip(s.row[bad], s.start[bad], s.end[bad])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(s.row[bad] + i)), pa.array(s.start[bad].astype(np.int32)),
                                                  pa.array(s.end[bad].astype(np.int32)), pa.array(p[bad], pa.float64()), pa.array(texts, pa.string())],
                                                 names=["doc_id", "start", "end", "score", "sentence"])

    return run


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score, sentence) of the sentences that offend by themselves; bytes of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_locator(shared, least), "doc_id long, start int, end int, score double, sentence string")
