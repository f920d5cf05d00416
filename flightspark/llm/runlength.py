"""Removal of byte strings that occur twice or more, marked by a run-length index.

Candidates come from winnowed seeds (see `seeds`): equal 400-byte windows share their seed, so each seed's stretches can be judged
by themselves. A stretch whose whole content occurs again is removed as it is. Where several contents share a seed, one copy of each
is cut to what another stretch of the seed can share, and what is still different goes to an index block: its Burrows-Wheeler transform is kept as runs with the text positions sampled at their ends and the match
length with the neighbouring suffix at each sample. Inside a run the match length falls by one per text position, so streaming
along the text from the samples gives the matching statistics of every position against all other positions of the block, and
positions with a match of 400 bytes or more start repeated windows.

A block holds whole seeds up to a bounded size. A seed with more contents than fit is not put into one task: its windows are
counted by fingerprint instead, which combines before the shuffle and is exact as well.

Defined results: a null text is empty; a null doc_id is a document like any other; repeated rows repeat each other's text; texts
shorter than the length cannot lose bytes; other columns pass through. Cutting may split a UTF-8 character; `dedup_text` then cuts
a little more, to whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightspark.llm.bytes_kit import Rolling, U64, buffers, free_name, mix, runs, slices
from flightspark.llm.seeds import Unit, seed_rows
from flightspark.llm.substring import _marked
from flightspark.session import checkpointed

BYTES = Unit(words=False, length=400, seed=32)
#: Steps in bytes in which the shared ends of stretches are looked up.
GRID = 32
#: Different contents around one seed that go into an index block; a seed with more is counted by window fingerprints.
BLOCK_KINDS = 600
#: Bytes of contents in a block, at which the next seed opens a new one.
BLOCK_BYTES = 1 << 19
KEYS = ["doc_id", "th"]
_KEY_TYPES = "doc_id long, th long"
_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))


# ---- the index of one block ------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of `text` in order, by prefix doubling up to the length after which no two are equal."""
    n = len(text)
    wide = np.zeros(n + 3, np.int64)
    wide[:n] = text + 1
    top = int(text.max()) + 2
    if top < (1 << 15):
        key, h = ((wide[:n] * top + wide[1: n + 1]) * top + wide[2: n + 2]) * top + wide[3: n + 3], 4
    else:
        key, h = wide[:n], 1
    while True:
        order = np.argsort(key)
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if h > longest or new.all():
            return order
        key = rank * (n + 1)
        key[: n - h] += rank[h:]
        h *= 2


class RunIndex:
    """Run-length Burrows-Wheeler transform of a text whose segments end in different terminators."""

    def __init__(self, text: np.ndarray, longest: int):
        self.text = text
        self.n = len(text)
        order = suffix_order(text, longest)
        bwt = text[order - 1]  # the suffix at 0 takes the last terminator, a symbol of its own
        head = np.ones(self.n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        at = np.flatnonzero(head)
        #: One entry per run: its symbol and length, and the text positions at its first and last row.
        self.symbols, self.lengths = bwt[at], np.diff(np.append(at, self.n))
        last = np.append(at[1:], self.n) - 1
        self.first, self.last = order[at], order[last]
        roll = Rolling(text.astype(U64) + U64(1))
        self.first_match = self._common(roll, self.first[1:], order[at[1:] - 1], longest)
        self.last_match = self._common(roll, self.last[:-1], order[last[:-1] + 1], longest)

    def _common(self, roll: Rolling, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b."""
        done = np.zeros(len(a), np.int64)
        step = 1 << int(longest).bit_length()
        while step:
            x, y = a + done + step, b + done + step
            fits = (x <= self.n) & (y <= self.n)
            equal = np.zeros(len(a), bool)
            i = np.flatnonzero(fits)
            equal[i] = roll.of(a[i] + done[i], x[i]) == roll.of(b[i] + done[i], y[i])
            done[equal] += step
            step >>= 1
        return done

    def matching(self) -> np.ndarray:
        """For each text position the longest match with any other position."""
        out = np.zeros(self.n, np.int64)
        for at, match in ((self.first[1:], self.first_match), (self.last[:-1], self.last_match)):
            reach = np.zeros(self.n, np.int64)
            reach[at] = at + match
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(self.n), out=out)
        return out


def repeated_in(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first start, starts) of the runs of positions in `bodies` that start a string of `length` occurring again."""
    size = np.array([len(b) for b in bodies], np.int64)
    text = np.empty(int(size.sum()) + len(bodies), np.int64)
    ends = np.cumsum(size + 1) - 1
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + len(bodies)
    text[ends] = np.arange(len(bodies))
    hit = RunIndex(text, int(size.max()) + 1).matching() >= length
    a, b = runs(hit)
    which = np.searchsorted(ends, a, "right")
    return which, a - (ends - size)[which], b - a


# ---- spans of repeated windows over all documents ----------------------------------------------------------------------------


def _codes(body: bytes, ahead: int, seed: int, unit: Unit) -> np.ndarray:
    """One number for each length on a grid to which the stretch is taken to the left and to the right of its seed."""
    roll = Rolling(np.frombuffer(body, np.uint8) + U64(1))
    left = np.arange(GRID, ahead + 1, GRID)
    right = np.arange(unit.seed + GRID, min(len(body) - ahead, unit.length) + 1, GRID)
    at = np.full(len(left) + len(right), ahead, np.int64)
    start = np.concatenate([ahead - left, at[len(left):]])
    end = np.concatenate([at[: len(left)], ahead + right])
    side = np.concatenate([np.zeros(len(left), U64), np.ones(len(right), U64)])
    return mix(roll.of(start, end) ^ mix(U64(seed & ((1 << 64) - 1)) + side)).view(np.int64)


def _bodies(unit: Unit):
    """mapInArrow body: (keys, text, looks) to the contents of the listed stretches with their codes, left ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            looks = batch.column("looks")
            flat = looks.flatten()
            row = np.repeat(np.arange(len(looks)), np.diff(np.asarray(looks.offsets, dtype=np.int64)))
            at, n, ahead, seed = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "n", "ahead", "seed"))
            start = off[row] + at
            raw = data.tobytes()
            for i in range(0, len(at), 2000):
                own = slice(i, min(i + 2000, len(at)))
                body = [raw[s: s + m + unit.length - 1] for s, m in zip(start[own], n[own])]
                codes = [_codes(b, int(p), int(s), unit) for b, p, s in zip(body, ahead[own], seed[own])]
                keys = batch.select(KEYS).take(pa.array(row[own])).columns
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)), pa.array(np.concatenate(codes)))
                yield pa.RecordBatch.from_arrays([*keys, flat.field("seed").slice(own.start, len(body)), flat.field("many").slice(own.start, len(body)), pa.array(at[own].astype(np.int32)),
                                                  pa.array(ahead[own].astype(np.int32)), pa.array(body, pa.binary()), lists], names=[*KEYS, "seed", "many", "at", "ahead", "body", "codes"])

    return run


def trimmed(stretch: DataFrame, unit: Unit) -> DataFrame:
    """Stretches without the ends that no other stretch of their seed shares, where a window is left: (keys, seed, many, at, body).

    A window can only occur again if its part left of the seed does, and its part right of it. Both parts are looked up on a grid
    of lengths; what lies beyond the next length of the grid is cut."""
    each = stretch.select(*KEYS, "at", "ahead", F.posexplode("codes").alias("k", "code"))
    twice = checkpointed(each.groupBy("code").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("code"))
    lefts = F.expr(f"CAST(ahead div {GRID} AS INT)")
    found = each.join(twice, "code").select(*KEYS, "at", F.when(F.col("k") < lefts, F.col("k") + 1).alias("l"), F.when(F.col("k") >= lefts, F.col("k") - lefts + 1).alias("r"))
    reach = checkpointed(found.groupBy(*KEYS, "at").agg(F.coalesce(F.max("l"), F.lit(0)).alias("l"), F.coalesce(F.max("r"), F.lit(0)).alias("r")))
    both = stretch.drop("codes").join(reach.hint("merge"), [*KEYS, "at"], "left").fillna(0, ["l", "r"])
    size = F.octet_length("body")
    left = F.least(F.col("ahead"), F.col("l") * GRID + GRID - 1)
    right = F.least(size - F.col("ahead"), F.lit(unit.seed) + F.col("r") * GRID + GRID - 1)
    out = both.withColumn("left", left).withColumn("right", right).filter(F.col("left") + F.col("right") >= unit.length)
    skip = F.col("ahead") - F.col("left")
    return out.select(*KEYS, "seed", "many", (F.col("at") + skip).cast("int").alias("at"), F.substring("body", skip + 1, F.col("left") + F.col("right")).alias("body"))


def _body_windows(unit: Unit):
    """mapInArrow body: contents to one row per window, with its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in slices(batch.column("body")):
                at = np.concatenate([np.arange(a, b - unit.length + 1) for a, b in zip(off[:-1], off[1:])])
                row = np.searchsorted(off, at, "right") - 1
                one, two = Rolling(data + U64(1), 0).of(at, at + unit.length), Rolling(mix(data + U64(77)), 1).of(at, at + unit.length)
                own = batch.take(pa.array(row + i))
                place = own.column("at").to_numpy() + at - off[row]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("th"), own.column("many"), pa.array(place.astype(np.int32)), pa.array(one.view(np.int64)),
                                                  pa.array(two.view(np.int64))], names=[*KEYS, "many", "at", "fp1", "fp2"])

    return run


def _blocks(unit: Unit, block_bytes: int):
    """mapInArrow body over rows sorted by seed: marks the repeats of whole seeds, a bounded number of bytes at a time."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        which, start, n = repeated_in([r[5] for r in rows], unit.length)
        keep = [k for k, w in enumerate(which) if not rows[w][3]]
        cols = [[rows[which[k]][c] for k in keep] for c in (0, 1)]
        at = [rows[which[k]][4] + int(start[k]) for k in keep]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(at, pa.int32()), pa.array([int(n[k]) for k in keep], pa.int32())],
                                          names=[*KEYS, "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, seed = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "seed", "many", "at", "body"))):
                if row[2] != seed and size >= block_bytes:
                    yield judge(rows)
                    rows, size = [], 0
                seed = row[2]
                rows.append(row)
                size += len(row[5])
        if rows:
            yield judge(rows)

    return run


def repeated_spans(docs: DataFrame, unit: Unit = BYTES, block_kinds: int = BLOCK_KINDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, th, spans): stretches of windows, as (at, n), whose string starts anywhere else too."""
    keyed = _keyed(docs)
    seeds = keyed.mapInArrow(seed_rows(unit, [], False), "seed long")
    shared = checkpointed(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("seed"))
    full = keyed.mapInArrow(seed_rows(unit, KEYS, True), f"{_KEY_TYPES}, seed long, at int, n int, ahead int, fp1 long, fp2 long")
    found = checkpointed(full.join(shared, "seed"))

    contents = checkpointed(found.groupBy("seed", "fp1", "fp2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEYS, "at", "n", "ahead")).alias("one")))
    kinds = checkpointed(contents.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    many = checkpointed(contents.filter("c > 1").select("seed", "fp1", "fp2"))
    whole = found.join(many, ["seed", "fp1", "fp2"]).select(*KEYS, "at", "n")

    # Where contents differ around a seed, one copy of each is cut to what others share; what is equal then is repeated whole.
    looks = contents.join(kinds, "seed").select("one.doc_id", "one.th", F.struct("seed", (F.col("c") > 1).alias("many"), "one.at", "one.n", "one.ahead").alias("look"))
    looks = looks.groupBy(*KEYS).agg(F.collect_list("look").alias("looks"))
    # Rows with one id and one text come once each; a copy repeats what is marked already.
    texts = keyed.join(looks.hint("merge"), KEYS).select(*KEYS, "text", "looks")
    stretch = checkpointed(texts.mapInArrow(_bodies(unit), f"{_KEY_TYPES}, seed long, many boolean, at int, ahead int, body binary, codes array<long>"))
    cut = trimmed(stretch, unit).withColumn("f1", F.xxhash64("body")).withColumn("f2", F.xxhash64(F.lit(1), "body"))
    cut = checkpointed(cut)
    narrow = cut.select(*KEYS, "seed", "many", "at", (F.octet_length("body") - (unit.length - 1)).alias("n"), "f1", "f2")
    groups = checkpointed(narrow.groupBy("seed", "f1", "f2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEYS, "at")).alias("one"), F.max("many").alias("many")))
    alike = checkpointed(groups.filter("c > 1").select("seed", "f1", "f2"))
    whole = whole.unionByName(narrow.filter("NOT many").join(alike, ["seed", "f1", "f2"]).select(*KEYS, "at", "n"))
    left = checkpointed(groups.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    ones = groups.join(left, "seed").select("one.doc_id", "one.th", "one.at", (F.col("many") | (F.col("c") > 1)).alias("many"), "kinds")
    rest = checkpointed(cut.drop("many", "f1", "f2").join(ones.hint("merge"), [*KEYS, "at"]))
    small = rest.filter(F.col("kinds") <= block_kinds).select(*KEYS, "seed", "many", "at", "body")
    marked = small.repartition("seed").sortWithinPartitions("seed", *KEYS, "at").mapInArrow(_blocks(unit, block_bytes), f"{_KEY_TYPES}, at int, n int")

    windows = rest.filter(F.col("kinds") > block_kinds).select(*KEYS, "many", "at", "body").mapInArrow(_body_windows(unit), f"{_KEY_TYPES}, many boolean, at int, fp1 long, fp2 long")
    windows = checkpointed(windows)
    twice = checkpointed(windows.groupBy("fp1", "fp2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    again = windows.filter("NOT many").join(twice, ["fp1", "fp2"]).select(*KEYS, "at", F.lit(1).alias("n"))
    spans = whole.unionByName(marked).unionByName(again)
    return spans.groupBy(*KEYS).agg(F.collect_set(F.struct("at", "n")).alias("spans"))


_CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                     T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())])


def _whole_characters(own: np.ndarray, lost: np.ndarray) -> bytes:
    """The kept bytes without characters that lost a part."""
    char = np.cumsum((own & 0xC0) != 0x80)
    hurt = np.bincount(char, weights=lost, minlength=int(char[-1]) + 1 if len(char) else 1) > 0
    return own[~hurt[char]].tobytes()


def _cutter(unit: Unit):
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], [], []]
        for i, j, data, off in slices(text):
            drop = _marked(spans.slice(i, j - i), off, unit.length, len(data))
            for r in range(j - i):
                own, lost = data[off[r]: off[r + 1]], drop[off[r]: off[r + 1]]
                n = int(lost.sum())
                cols[0].append(len(own))
                cols[1].append(n)
                cols[2].append(len(runs(lost)[0]) if n else 0)
                cols[3].append(hashlib.sha256(own[~lost].tobytes() if n else own.tobytes()).hexdigest())
                cols[4].append(_whole_characters(own, lost).decode() if n else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], fields=[pa.field(f.name, t) for f, t in zip(_CUT.fields, kinds)])

    return F.arrow_udf(cut, _CUT)


def remove_repeats(docs: DataFrame, unit: Unit = BYTES, name: str = "_cut", **options) -> DataFrame:
    """`docs` with a struct column `name`: n_bytes, n_removed, n_spans, kept_sha256, and the kept text where bytes were removed."""
    k, h, s = (free_name(docs.columns, c) for c in ("_k", "_h", "_spans"))
    spans = repeated_spans(docs, unit, **options).select(F.col("doc_id").alias(k), F.col("th").alias(h), F.col("spans").alias(s))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col(k)) & (F.xxhash64(body) == F.col(h))
    none = F.array().cast("array<struct<at: int, n: int>>")
    return docs.join(spans, same, "left").withColumn(name, _cutter(unit)(body, F.coalesce(s, none))).drop(k, h, s)


def dedup_text(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """`docs` with repeated strings cut out of `text`, to whole characters; other texts stay byte for byte."""
    name = free_name(docs.columns, "_cut")
    cut = remove_repeats(docs, unit, name=name)
    return cut.select(*[F.coalesce(F.col(f"{name}.text"), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
