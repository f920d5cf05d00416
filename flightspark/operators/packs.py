"""Rows of a key as arrays, for passes over everything that belongs to a frame.

Pixels are many and narrow. Sent row by row, each carries its key and takes eight bytes a column; packed, the key goes once and the columns
lie one after the other. A pack holds what one batch of rows has of a key, so it is bounded however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a pass gives on at once.
ROWS = 1 << 15


def known(cols: Sequence[str]):
    """None of the columns is null."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def packed(df: DataFrame, by: Sequence[str], cols: Sequence[str], whole: bool = True) -> DataFrame:
    """(by, cols): the columns as arrays, a row for every key of every batch. Rows without a whole key are left out, unless `whole` is not set."""
    by, cols = list(by), list(cols)
    kind = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*[T.StructField(c, kind[c]) for c in by], *[T.StructField(c, T.ArrayType(kind[c])) for c in cols]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in by]
            order = np.lexsort(code[::-1])
            code = [k[order] for k in code]
            first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in code], axis=0)])
            ends = pa.array(np.r_[first, len(order)].astype(np.int32))
            at, rows = pa.array(order[first]), pa.array(order)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in by], *[pa.ListArray.from_arrays(ends, batch.column(c).take(rows)) for c in cols]],
                                             names=[*by, *cols])

    return (df.filter(known(by)) if whole else df).select(*by, *cols).mapInArrow(run, schema)


class Lists:
    """An array column of a batch: the values of a row as numpy, nulls as NaN, or as Arrow."""

    def __init__(self, column: pa.Array):
        self.ends, self.arrow = column.offsets.to_numpy(), column.values
        self.flat = None

    def of(self, i: int) -> np.ndarray:
        if self.flat is None:
            self.flat = self.arrow.to_numpy(zero_copy_only=False)
        return self.flat[self.ends[i]:self.ends[i + 1]]

    def whole(self, i: int) -> pa.Array:
        return self.arrow.slice(self.ends[i], self.ends[i + 1] - self.ends[i])

    def missing(self, i: int) -> np.ndarray:
        return self.whole(i).is_null().to_numpy(zero_copy_only=False)


def numbered(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers of the pixels, equal ones alike."""
    code = (u - u.min()) * (int(v.max() - v.min()) + 1) + (v - v.min()) if len(u) else u
    return np.unique(code, return_inverse=True)[1].reshape(-1)


def places(u: np.ndarray, v: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A look-up of pixels among (u, v): pairs of places, one for every pixel that is asked for and every equal one that is there."""
    if not len(u):
        return lambda qu, qv: (np.empty(0, np.int64),) * 2
    u0, v0, u1, v1 = u.min(), v.min(), u.max(), v.max()
    wide = int(v1 - v0) + 1
    code = (u - u0) * wide + (v - v0)
    order = np.argsort(code, kind="stable")
    code = code[order]

    def find(qu: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asked = np.flatnonzero((qu >= u0) & (qu <= u1) & (qv >= v0) & (qv <= v1))
        q = (qu[asked] - u0) * wide + (qv[asked] - v0)
        lo, n = np.searchsorted(code, q, "left"), np.searchsorted(code, q, "right")
        n -= lo
        if len(n) and n.max() > 1:
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.repeat(asked, n), order[np.repeat(lo, n) + within]
        hit = n > 0
        return asked[hit], order[lo[hit]]

    return find


def by_frame(df: DataFrame, key: Sequence[str], *order: str, block: int = 1) -> DataFrame:
    """Dealt out by (flight, frame), with `block` neighbouring frames in one task, and sorted by key and `order` there."""
    flight, frame = key
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.col(frame) if block == 1 else F.floor(F.col(frame) / block)
    return df.repartition(n, flight, place).sortWithinPartitions(flight, frame, *order)


def frames(batches: Iterable[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[tuple, int, dict, int]]:
    """Rows of a sorted pass: key (flight, frame), `_kind`, the columns of the batch (arrays as `Lists`) and the row's place in them."""
    for batch in batches:
        flight, frame, kind = (batch.column(c).to_pylist() for c in (*key, "_kind"))
        cols = {f.name: Lists(batch.column(f.name)) if pa.types.is_list(f.type) else batch.column(f.name) for f in batch.schema}
        for i in range(batch.num_rows):
            yield (flight[i], frame[i]), kind[i], cols, i
