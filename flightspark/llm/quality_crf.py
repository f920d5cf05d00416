"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before and after it; the chain ties neighbouring
labels. Training lines carry the label of their document. The marginals of forward-backward, weighted by line length, give a
document's share of good text, and a logistic curve fitted on the training sample turns that share into the score.

Only the text enters a score. Defined results: empty lines are skipped; null and empty texts have no line and get the share of
good rows in the training sample; if one class is missing in the sample every score is that share (0 without any row); ids may
repeat or be null, a null id is never used for training; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightspark.llm.bytes_kit import WIDE_SLICE, Rolling, U64, Words, mix, slices
from flightspark.llm.toxicity import held_out, sample

SCORED = "doc_id long, held_out boolean, score double, predicted int, n_lines int, n_bad_lines int"
#: Documents with a score of at least this are predicted to be good.
CUT = 0.3
OWN = ("symbols", "capitals", "exclaims", "digits", "pipes", "same_word", "repeat", "dup_line", "ends", "short", "long_words")
NEAR = 9  # of these, the first so many are also taken from both neighbours
_SETS = {name: np.isin(np.arange(256), list(chars)) for name, chars in
         {"symbols": b"#*$%&|<>", "exclaims": b"!", "digits": b"0123456789", "pipes": b"|", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123))}.items()}
_ENDS = np.isin(np.arange(256), list(b".!?:;\"')"))


@dataclass
class Lines:
    x: np.ndarray  # features of each line, its own and its neighbours'
    row: np.ndarray
    size: np.ndarray  # bytes of words


def _again(keys: np.ndarray, first_too: bool) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[order] = same[:-1] | same[1:] if first_too else same[:-1]
    return out


def lines(data: np.ndarray, off: np.ndarray) -> Lines:
    w = Words(data, off)
    if not len(w):
        return Lines(np.zeros((0, len(OWN) + 2 * NEAR + 1)), np.zeros(0, np.int64), np.zeros(0))
    roll = Rolling(data + U64(1))
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=breaks[1:])
    new = np.ones(len(w), bool)
    new[1:] = (breaks[w.start[1:]] != breaks[w.start[:-1]]) | (w.row[1:] != w.row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(w)) - 1
    row, start, end = w.row[head], w.start[head], w.end[tail]
    count = (tail - head + 1).astype(float)
    size = np.add.reduceat(w.end - w.start, head).astype(float)

    def per(name: str) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_SETS[name][data], out=total[1:])
        return (total[end] - total[start]).astype(float)

    h = w.hashes(roll)
    salt = mix(np.arange(1, len(off), dtype=U64))
    same = np.zeros(len(w))
    same[1:] = (h[1:] == h[:-1]) & ~new[1:]
    tri = Rolling(h).grams(3)
    ok = w.whole(3)
    repeat = np.zeros(len(w))
    repeat[np.flatnonzero(ok)] = _again(mix(tri[ok] ^ salt[w.row[: len(tri)][ok]]), True)
    upper, lower = per("upper"), per("lower")
    dup = _again(mix(roll.of(start, end) ^ salt[row]), False)
    own = np.stack([np.minimum(per("symbols") / count, 2), (upper > lower).astype(float), np.minimum(per("exclaims") / count, 2), per("digits") / size,
                    np.minimum(per("pipes") / count, 2), np.add.reduceat(same, head) / count, np.add.reduceat(repeat, head) / count, dup.astype(float),
                    _ENDS[data[end - 1]].astype(float), (count < 4).astype(float), (size > 15 * count).astype(float)], axis=1)
    before, after = np.zeros((len(head), NEAR)), np.zeros((len(head), NEAR))
    tied = row[1:] == row[:-1]
    before[1:][tied] = own[:-1, :NEAR][tied]
    after[:-1][tied] = own[1:, :NEAR][tied]
    return Lines(np.concatenate([own, before, after, np.ones((len(head), 1))], axis=1), row, size)


class Chains:
    """Lines of many documents ordered so that step t of every chain longer than t is one slice."""

    def __init__(self, row: np.ndarray):
        self.rows, first, count = np.unique(row, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        self.first, self.count = first[order], count[order]
        self.alive = np.searchsorted(-self.count, -np.arange(1, (self.count[0] if len(count) else 0) + 1), "right")

    def marginals(self, e: np.ndarray, t: np.ndarray, pairs: bool = False):
        """Log odds of good for every line from emission log odds `e` and transition scores t[from][to]."""
        ahead, back = np.zeros(len(e)), np.zeros(len(e))
        for step, n in enumerate(self.alive):
            at = self.first[:n] + step
            if step:
                r = ahead[at - 1]
                ahead[at] = e[at] + np.logaddexp(t[0, 1], r + t[1, 1]) - np.logaddexp(t[0, 0], r + t[1, 0])
            else:
                ahead[at] = e[at]
        for step in range(len(self.alive) - 2, -1, -1):
            at = self.first[: self.alive[step + 1]] + step
            q = e[at + 1] + back[at + 1]
            back[at] = np.logaddexp(t[1, 0], t[1, 1] + q) - np.logaddexp(t[0, 0], t[0, 1] + q)
        if not pairs:
            return ahead + back
        expected = np.zeros((2, 2))
        for step in range(len(self.alive) - 1):
            at = self.first[: self.alive[step + 1]] + step
            q = e[at + 1] + back[at + 1]
            s = np.stack([np.full(len(at), t[0, 0]), t[0, 1] + q, ahead[at] + t[1, 0], ahead[at] + t[1, 1] + q])
            s = np.exp(s - s.max(axis=0))
            expected += (s / s.sum(axis=0)).sum(axis=1).reshape(2, 2)
        return ahead + back, expected


@dataclass
class Model:
    emit: np.ndarray
    move: np.ndarray
    slope: float
    shift: float
    prior: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _share(model: Model, ls: Lines, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted share of good text of each row (nan without lines) and its bad lines."""
    good = _sigmoid(Chains(ls.row).marginals(ls.x @ model.emit, model.move)) if len(ls.row) else np.zeros(0)
    size = np.bincount(ls.row, weights=ls.size, minlength=rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(ls.row, weights=ls.size * good, minlength=rows) / size, np.bincount(ls.row, weights=good < 0.5, minlength=rows).astype(int)


def _curve(share: np.ndarray) -> np.ndarray:
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def train(texts: pa.Array, labels: np.ndarray, *, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    prior = float(labels.mean()) if len(labels) else 0.0
    width = len(OWN) + 2 * NEAR + 1
    model = Model(np.zeros(width), np.zeros((2, 2)), 1.0, 0.0, prior)
    if not 0 < prior < 1:
        return model
    parts = [(i, lines(data, off)) for i, _, data, off in slices(texts)]
    ls = Lines(np.concatenate([p.x for _, p in parts]), np.concatenate([p.row + i for i, p in parts]), np.concatenate([p.size for _, p in parts]))
    chains, y = Chains(ls.row), labels[ls.row].astype(float)
    n = len(y)
    observed = np.zeros((2, 2))
    for v in (0, 1):
        observed[v, v] = (chains.count[labels[ls.row[chains.first]] == v] - 1).sum()
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        odds, expected = chains.marginals(ls.x @ theta[:width], theta[width:].reshape(2, 2), True)
        g = np.concatenate([ls.x.T @ (y - _sigmoid(odds)), (observed - expected).ravel()]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    model.emit, model.move = theta[:width], theta[width:].reshape(2, 2)
    share, _ = _share(model, ls, len(labels))
    has = ~np.isnan(share)
    z, t = _curve(share[has]), labels[has].astype(float)
    a, b = 1.0, 0.0
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    for _ in range(500):
        d = weight * (t - _sigmoid(a * z + b))
        a, b = a + 0.05 * ((d * z).mean() - 1e-3 * a), b + 0.05 * d.mean()
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", **options) -> Model:
    """Trains on the driver on the bounded sample of `toxicity.sample`."""
    rows = sample(docs, labels, target).toArrow().sort_by("doc_id")
    return train(rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(int), **options)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            out = [[], [], []]
            for i, j, data, off in slices(batch.column("text"), WIDE_SLICE):
                ls = lines(data, off)
                share, bad = _share(model, ls, j - i)
                score = _sigmoid(model.slope * _curve(share) + model.shift) if 0 < model.prior < 1 else np.full(j - i, model.prior)
                out[0].append(np.where(np.isnan(share), model.prior, score))
                out[1].append(np.bincount(ls.row, minlength=j - i))
                out[2].append(bad)
            score, count, bad = (np.concatenate(x) if x else np.zeros(0) for x in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(bad.astype(np.int32))], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row: score, prediction, lines and bad lines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), SCORED)
