"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into *units* at places that no piece of the model spans (before a space mark, around line feeds, ...), so units can be
encoded by themselves. Each different unit is encoded once: its substrings up to the longest piece are exploded and joined with the
piece table, the edges are grouped by unit, and the best path is folded with the higher-order function `aggregate`:

* a unigram model takes the path with the highest sum of scores (Viterbi);
* a byte-pair model has no such sum: there the edges are folded in order of their scores, and an edge becomes a symbol if it covers
  exactly two symbols that stand at its turn. For pieces built from better pieces, as training makes them, that is what merging the
  best pair again and again gives. Pieces of space marks only may be built from worse ones; their edges are merged afterwards,
  best first and from left to right, which needs few steps since runs of marks are cut to the longest such piece.

Characters without a piece fall back to their bytes, or to the unknown piece if the model has no bytes.

The most frequent units, a fixed number of bounded length, are broadcast to the tasks that assemble documents; the encodings of all
other units reach their documents by a join. Texts are shuffled once, compressed. Nothing is dropped, whatever the vocabulary.

Folding edges takes time with the square of a unit. Under a byte-pair model, units of more than 2,048 characters without a cut are
therefore merged from a queue, in the same order, in chunks that overlap. Pieces form the encoding of a unit just if each
two neighbours form the encoding of their own text; so chunks that have one piece in common are joined there, without loss.

Defined results: null and empty texts have no piece; a null doc_id is a document like any other; repeated rows give repeated
results; other columns are left out by `encode`. Decoding gives the text back byte for byte, but for space marks that stood in the
text itself, which the format cannot tell from spaces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightspark.llm.bytes_kit import Rolling, U64, mix, slices
from flightspark.session import checkpointed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = 0x2581
#: Units that are broadcast, and the characters one of them may have.
HOT_UNITS, HOT_CHARS = 600_000, 48
#: Bytes of text that a task takes up at once; a unit's bookkeeping is many times its text.
SLICE = 1 << 18
_PAIR_BITS = 20


@dataclass
class Vocabulary:
    """Pieces of a model: text (with the space mark), id and score; ids of the 256 bytes, or none; whether merges decide."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int] | None
    unknown: int
    merges: bool
    size: int

    @staticmethod
    def load(path: str = MODEL, merges: bool = True) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = [(m.is_control(i) or m.is_unknown(i) or m.is_unused(i), m.is_byte(i)) for i in range(n)]
        pieces = [(m.id_to_piece(i), i, m.get_score(i)) for i in range(n) if not kinds[i][0] and not kinds[i][1]]
        named = {m.id_to_piece(i): i for i in range(n) if kinds[i][1]}
        return Vocabulary(pieces, [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else None, m.unk_id(), merges, n)

    def mark_run(self) -> int:
        """The longest piece of space marks only; checks that such pieces can be merged after all others, in chunks of that length."""
        mark = chr(SPACE_MARK)
        runs = {len(p): s for p, _, s in self.pieces if len(p) > 1 and not p.strip(mark)}
        if not runs or not self.merges:
            return 1 << 30
        longest = max(runs)
        others = [(p, s) for p, _, s in self.pieces if len(p) > 1 and p.strip(mark)]
        if longest > 30 or self.longest() > 31 or self.size > 1 << 17 or any(mark * 2 in p for p, _ in others) or runs.get(2, 0.0) > min((s for _, s in others), default=0.0):
            raise ValueError("this model has pieces that are too long or mix with space marks")
        for k in range(2, 3 * longest):
            sizes = [1] * k
            while True:
                open_ = [(-runs[a + b], i) for i, (a, b) in enumerate(zip(sizes, sizes[1:])) if a + b in runs]
                if not open_:
                    break
                i = min(open_)[1]
                sizes[i: i + 2] = [sizes[i] + sizes[i + 1]]
            if sizes[: (k - 1) // longest] != [longest] * ((k - 1) // longest):
                raise ValueError("runs of space marks cannot be cut in this model")
        return longest

    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    def joinable(self) -> np.ndarray:
        """By hashed pair of characters: whether some piece may hold them side by side."""
        pairs = {(ord(a) << 21) | ord(b) for p, _, _ in self.pieces for a, b in zip(p, p[1:])}
        out = np.zeros(1 << _PAIR_BITS, bool)
        if pairs:
            out[_pair_slot(np.array(sorted(pairs), U64))] = True
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank); rank grows as the score falls and is shared by equal scores. A few ten thousand rows at most."""
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return spark.createDataFrame([(p, i, order[s], float(s)) for p, i, s in self.pieces], "piece string, id int, rank int, score double")

    def bytes_of(self) -> list[bytes]:
        out = [b""] * self.size
        for p, i, _ in self.pieces:
            out[i] = p.replace(chr(SPACE_MARK), " ").encode()
        for b, i in enumerate(self.byte_ids or ()):
            out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        return out


def _pair_slot(pair: np.ndarray) -> np.ndarray:
    return (mix(pair) >> U64(64 - _PAIR_BITS)).astype(np.int64)


@dataclass
class Cuts:
    """Where texts may be cut without changing their encoding."""

    joinable: np.ndarray
    mark_run: int

    @staticmethod
    def of(vocabulary: Vocabulary) -> Cuts:
        return Cuts(vocabulary.joinable(), vocabulary.mark_run())


class Units:
    """Units of the texts of a slice: their bounds in the marked characters, their row, and a hash of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, cuts: Cuts):
        joinable = cuts.joinable
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        bound = heads[off]
        some = np.diff(bound) > 0
        # A space mark is put before every text that has a character.
        lead = np.concatenate([[0], np.cumsum(some)])
        row_of = np.repeat(np.arange(len(off) - 1), np.diff(bound))
        self.chars = np.full(len(chars) + int(lead[-1]), SPACE_MARK, np.uint32)
        self.chars[np.arange(len(chars)) + lead[row_of + 1]] = np.where(chars == 32, np.uint32(SPACE_MARK), chars)
        self.bound = bound + lead
        n = len(self.chars)
        cut = np.ones(n + 1, bool)
        if n > 1:
            wide = self.chars.astype(U64)
            cut[1:n] = ~joinable[_pair_slot((wide[:-1] << U64(21)) | wide[1:])]
        cut[self.bound] = True
        mark = np.flatnonzero(self.chars == SPACE_MARK)
        if len(mark):
            begins = cut[mark] | (np.diff(mark, prepend=-2) != 1)
            since = mark - np.maximum.accumulate(np.where(begins, mark, 0))
            cut[mark[since % cuts.mark_run == 0]] = True
        at = np.flatnonzero(cut[:n]) if n else np.zeros(0, np.int64)
        self.start, self.end = at, np.append(at[1:], n) if n else at
        self.uid = Rolling(self.chars + np.uint32(1)).of(self.start, self.end).view(np.int64)
        self.first = np.searchsorted(self.start, self.bound)

    def texts(self, which: np.ndarray) -> list[str]:
        size = self.end[which] - self.start[which]
        stop = np.cumsum(size)
        at = np.repeat(self.start[which] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        joined = self.chars[at].tobytes().decode("utf-32-le")
        return [joined[b - s: b] for b, s in zip(stop.tolist(), size.tolist())]


def _counter(joinable):
    """mapInArrow body: texts to (uid, unit, n), combined over some megabytes at a time."""

    def pack(kept: list[tuple[np.ndarray, list[str], np.ndarray]]) -> pa.RecordBatch:
        uid = np.concatenate([k[0] for k in kept])
        units = pa.concat_arrays([pa.array(k[1], pa.string()) for k in kept])
        order, first, back = np.unique(uid, return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([k[2] for k in kept])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(order), units.take(pa.array(first)), pa.array(n)], names=["uid", "unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for _, _, data, off in slices(batch.column("text"), SLICE):
                u = Units(data, off, joinable.value)
                uid, first, n = np.unique(u.uid, return_index=True, return_counts=True)
                kept.append((uid, u.texts(first), n))
                size += len(uid)
                if size > 120_000:
                    yield pack(kept)
                    kept, size = [], 0
        if kept:
            yield pack(kept)

    return run


def units(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, unit, n): the different units of all texts and how often they come."""
    joinable = docs.sparkSession.sparkContext.broadcast(Cuts.of(vocabulary))
    rows = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    counted = rows.mapInArrow(_counter(joinable), "uid long, unit string, n long")
    return counted.groupBy("uid").agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))


# ---- the lattice -------------------------------------------------------------------------------------------------------------

#: Characters up to which the bounds of a unit are the bits of one number.
NARROW = 61
# Edges of a byte-pair lattice are numbers. An edge of several characters: whether it is of space marks only (1 bit), rank (17),
# start (22), length (5), id (18), so that they sort in the order of merging. An edge of one character is -1 - (start << 22 | what),
# what being its id, or its code point with bit 21 set if it has no piece.
_S, _E, _ID = "(shiftright(x, 23) & 4194303L)", "((shiftright(x, 23) & 4194303L) + (shiftright(x, 18) & 31L))", "CAST(x & 262143L AS INT)"
_MARKS = "shiftleft(1L, 62)"


#: Characters above which a unit is merged from a queue, and of the chunks and overlaps it is then taken in.
LONG_UNIT, CHUNK, OVERLAP = 2048, 1 << 18, 256


def _substrings(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, size, s, l, piece, id, rank, score): the substrings that are pieces, and characters without one, whose id is null.

    The piece table is bounded by the model, and so is its broadcast."""
    size = F.char_length("unit")
    starts = words.select("uid", "unit", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest()), F.col("size") - F.col("s")))
    subs = starts.select("uid", "size", "s", "unit", F.explode(lengths).alias("l"))
    subs = subs.select("uid", "size", "s", "l", F.substring("unit", F.col("s") + 1, F.col("l")).alias("piece"))
    return subs.join(F.broadcast(vocabulary.table(words.sparkSession)), "piece", "left").filter("id IS NOT NULL OR l = 1")


def _viterbi(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, path) by the highest sum of scores; path holds the chosen edges (s, id, code) from left to right."""
    edge = F.struct("s", (F.col("s") + F.col("l")).alias("e"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(-1e6)).alias("score"),
                    F.when(F.col("id").isNull(), F.ascii("piece")).alias("code"))
    found = _substrings(words, vocabulary).groupBy("uid").agg(F.max("size").alias("size"), F.collect_list(edge).alias("edges"))
    # best[e] = (sum of scores, start, id, code) of the best edge into e; then back from the end.
    start = "array(struct(CAST(0 AS DOUBLE) AS v, 0 AS s, -2 AS id, CAST(NULL AS INT) AS code))"
    step = ("(a, e) -> concat(a, array(array_max(transform(filter(edges, x -> x.e = e), "
            "x -> struct(a[x.s].v + x.score AS v, x.s AS s, x.id AS id, x.code AS code)))))")
    best = found.withColumn("best", F.expr(f"aggregate(sequence(1, size), {start}, {step})"))
    back = ("aggregate(sequence(1, size), struct(size AS at, CAST(array() AS ARRAY<STRUCT<s: INT, id: INT, code: INT>>) AS p), "
            "(a, i) -> IF(a.at = 0, a, struct(best[a.at].s AS at, concat(array(struct(best[a.at].s AS s, best[a.at].id AS id, best[a.at].code AS code)), a.p) AS p))).p")
    return best.select("uid", F.expr(back).alias("path"))


def _merged(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, path) by merges: the symbol bounds of a unit are folded over its edges in order."""
    marks = F.col("piece").rlike(f"^{chr(SPACE_MARK)}{{2,}}$").cast("long")
    put = lambda c, bits: F.shiftleft(F.col(c).cast("long"), bits)
    many = F.shiftleft(marks, 62) + put("rank", 45) + put("s", 23) + put("l", 18) + F.col("id").cast("long")
    one = F.lit(-1) - (put("s", 22) + F.coalesce(F.col("id"), F.ascii("piece") + F.lit(1 << 21)).cast("long"))
    edges = _substrings(words, vocabulary).select("uid", "size", F.when(F.col("l") > 1, many).otherwise(one).alias("edge"))
    found = edges.groupBy("uid").agg(F.max("size").alias("size"), F.collect_list("edge").alias("edges"))

    inner = f"(shiftleft(1L, CAST({_E} AS INT)) - shiftleft(2L, CAST({_S} AS INT)))"
    rim = f"(shiftleft(1L, CAST({_E} AS INT)) | shiftleft(1L, CAST({_S} AS INT)))"
    merges = f"(a & {rim}) = {rim} AND bit_count(a & {inner}) = 1"
    proper = f"array_sort(filter(edges, x -> x >= 0 AND x < {_MARKS}))"
    fold = f"aggregate({proper}, shiftleft(1L, size + 1) - 1, (a, x) -> IF({merges}, a & ~{inner}, a))"
    # Pieces of marks lie in the first few characters, so the low bits are enough for them.
    after = (f"aggregate(sequence(1, 31), {{low}}, (a, i) -> aggregate(array(array_min(filter(edges, x -> x >= {_MARKS} AND {merges}))), a, "
             f"(b, x) -> IF(x IS NULL, b, b & ~{inner})))")
    marked = f"exists(edges, x -> x >= {_MARKS})"
    # Longer units: 32 bounds a word, so that an edge looks at few words.
    bit = "(shiftright(coalesce(a[CAST({0} div 32 AS INT)], 0L), CAST({0} % 32 AS INT)) & 1L)"
    inside = f"aggregate(sequence({_S}, {_E}), 0L, (c, i) -> c + {bit.format('i')})"
    clear = (f"transform(a, (w, j) -> IF(j < {_S} div 32 OR j > {_E} div 32, w, "
             f"w & ~aggregate(sequence({_S} + 1, {_E} - 1), 0L, (c, i) -> c | IF(i div 32 = j, shiftleft(1L, CAST(i % 32 AS INT)), 0L))))")
    open_ends = f"{bit.format(_S)} = 1L AND {bit.format(_E)} = 1L"
    init = "transform(sequence(0, CAST(size div 32 AS INT)), j -> 4294967295L)"
    wide_fold = f"aggregate({proper}, {init}, (a, x) -> IF({open_ends} AND {inside} = 3L, {clear}, a))"

    small = f"size <= {NARROW}"
    folded = found.withColumn("a", F.expr(f"IF({small}, {fold}, 0L)")).withColumn("w", F.expr(f"IF({small}, NULL, {wide_fold})"))
    folded = folded.withColumn("a", F.expr(f"IF({marked} AND {small}, {after.format(low='a')}, a)"))
    folded = folded.withColumn("w", F.expr(f"IF({marked} AND w IS NOT NULL, transform(w, (v, j) -> IF(j = 0, {after.format(low='v')}, v)), w)"))
    z = "(-1L - x)"
    at, what = f"shiftright({z}, 22)", f"({z} & 4194303L)"
    single = f"struct(CAST({at} AS INT) AS s, IF({what} < 2097152L, CAST({what} AS INT), -1) AS id, IF({what} < 2097152L, NULL, CAST({what} - 2097152L AS INT)) AS code)"
    several = f"struct(CAST({_S} AS INT) AS s, {_ID} AS id, CAST(NULL AS INT) AS code)"
    pick = "array_sort(concat(transform(filter(edges, x -> x >= 0 AND {many}), x -> {several}), transform(filter(edges, x -> x < 0 AND {one}), x -> {single})))"
    near = pick.format(many=f"(a & {rim}) = {rim} AND (a & {inner}) = 0", one=f"(shiftright(a, CAST({at} AS INT)) & 3L) = 3L", several=several, single=single)
    far = pick.format(many=f"{open_ends} AND {inside} = 2L", one=f"{bit.format(at)} = 1L AND {bit.format(f'({at} + 1)')} = 1L", several=several, single=single).replace("a[CAST(", "w[CAST(")
    return folded.select("uid", F.expr(f"IF({small}, {near}, {far})").alias("path"))


def queue_merge(text: str, order: dict[str, int], longest: int) -> list[int]:
    """Bounds of the symbols of a text: the pair of least order, the leftmost of equals, is merged until no pair is a piece."""
    n = len(text)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(order[text[i: i + 2]] << 40) + i for i in range(n - 1) if text[i: i + 2] in order]
    heapq.heapify(queue)
    while queue:
        first = heapq.heappop(queue)
        i = first & ((1 << 40) - 1)
        e = end[i]
        if not e or e >= n or order.get(text[i: end[e]]) != first >> 40:
            continue  # one of the two has been merged since
        end[i], end[e] = end[e], 0
        e = end[i]
        if e < n:
            before[e] = i
        for a, b in ((before[i], e), (i, end[e] if e < n else 0)):
            if a >= 0 and b - a <= longest and (rank := order.get(text[a:b])) is not None:
                heapq.heappush(queue, (rank << 40) + a)
    bounds, i = [0], 0
    while i < n:
        i = end[i]
        bounds.append(i)
    return bounds


def long_bounds(text: str, order: dict[str, int], longest: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """`queue_merge` in chunks. Each begins at a bound of the one before, `overlap` pieces from its end, and is joined to it
    behind the first piece that both have. Should there be none, the text is merged as a whole."""
    bounds, stop = queue_merge(text[:chunk], order, longest), chunk
    while stop < len(text):
        tail = bounds[-1 - overlap:]
        at, stop = tail[0], tail[0] + chunk
        own = [at + x for x in queue_merge(text[at:stop], order, longest)]
        share = set(zip(tail, tail[1:]))
        join = next((b for a, b in zip(own, own[1:]) if (a, b) in share), None)
        if join is None:
            return queue_merge(text, order, longest)
        del bounds[len(bounds) - len(tail) + tail.index(join) + 1:]
        bounds += [x for x in own if x > join]
    return bounds


def _queued(vocabulary: Vocabulary):
    """mapInArrow body: (uid, unit) to (uid, ids), for long units."""
    ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in vocabulary.pieces}, reverse=True))}
    mark = chr(SPACE_MARK)
    order = {p: ranks[s] + (0 if p.strip(mark) else len(ranks)) for p, _, s in vocabulary.pieces if len(p) > 1}
    known, longest = {p: i for p, i, _ in vocabulary.pieces}, vocabulary.longest()
    byte_ids, unknown = vocabulary.byte_ids, vocabulary.unknown

    def spell(piece: str) -> list[int]:
        if (one := known.get(piece)) is not None:
            return [one]
        return [byte_ids[b] for b in piece.encode()] if byte_ids else [unknown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, unit in zip(batch.column("uid"), batch.column("unit")):
                text = unit.as_py()
                bounds = long_bounds(text, order, longest)
                ids = np.fromiter((i for a, b in zip(bounds, bounds[1:]) for i in spell(text[a:b])), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))],
                                                 names=["uid", "ids"])

    return run


def encode_units(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(uid, ids) for a table (uid, unit, ...) of different units."""
    if not vocabulary.merges:
        return _spelled(_viterbi(words, vocabulary), vocabulary)
    size = F.char_length("unit")
    # Few bytes but much work a unit: dealt out by number, not by size; the lattice then needs no shuffle of its own.
    short = words.filter(size <= LONG_UNIT).repartition(4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid")
    folded = _spelled(_merged(short, vocabulary), vocabulary)
    return folded.unionByName(words.filter(size > LONG_UNIT).select("uid", "unit").repartition("uid").mapInArrow(_queued(vocabulary), "uid long, ids array<int>"))


def _spelled(paths: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Paths as ids, with bytes for characters without a piece."""
    if vocabulary.byte_ids is None:
        return paths.select("uid", F.transform("path", lambda x: F.when(x["id"] < 0, F.lit(vocabulary.unknown)).otherwise(x["id"])).alias("ids"))
    table = F.array(*[F.lit(i) for i in vocabulary.byte_ids])

    def spelled(x: Column) -> Column:
        c = x["code"]
        tail = lambda k: F.shiftright(c, k).bitwiseAND(F.lit(63)) + 128
        numbers = (F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(F.shiftright(c, 6) + 192, tail(0)))
                   .when(c < 0x10000, F.array(F.shiftright(c, 12) + 224, tail(6), tail(0)))
                   .otherwise(F.array(F.shiftright(c, 18) + 240, tail(12), tail(6), tail(0))))
        return F.when(x["id"] >= 0, F.array(x["id"])).otherwise(F.transform(numbers, lambda b: F.element_at(table, b + 1)))

    plain = F.transform("path", lambda x: x["id"])
    return paths.select("uid", F.when(F.exists("path", lambda x: x["id"] < 0), F.flatten(F.transform("path", spelled))).otherwise(plain).alias("ids"))


# ---- documents ---------------------------------------------------------------------------------------------------------------


@dataclass
class Spelling:
    """Bytes of all pieces, one after the other."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary) -> Spelling:
        each = vocabulary.bytes_of()
        size = np.array([len(b) for b in each], np.int64)
        return Spelling(np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size)

    def texts(self, ids: pa.ListArray) -> list[str]:
        own = np.asarray(ids.flatten(), dtype=np.int64)
        n = self.size[own]
        stop = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.start[own] - stop[:-1], n) + np.arange(int(stop[-1]))
        raw = self.flat[at].tobytes()
        cut = stop[np.asarray(ids.offsets, dtype=np.int64) - ids.offsets[0].as_py()]
        return [raw[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Lookup:
    """Encodings by uid in flat arrays."""

    def __init__(self, uid: np.ndarray, ids: pa.ListArray):
        order = np.argsort(uid)
        self.uid = uid[order]
        off = np.asarray(ids.offsets, dtype=np.int64)
        self.start, self.count = off[:-1][order], np.diff(off)[order]
        self.flat = np.asarray(ids.values, dtype=np.int32)

    def find(self, uid: np.ndarray) -> np.ndarray:
        """Place of each uid, or -1."""
        if not len(self.uid):
            return np.full(len(uid), -1)
        at = np.minimum(np.searchsorted(self.uid, uid), len(self.uid) - 1)
        return np.where(self.uid[at] == uid, at, -1)


def _list_of(col) -> pa.ListArray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pa.ListArray.from_arrays(pa.array(np.asarray(col.offsets) - col.offsets[0].as_py()), col.flatten()) if len(col) else col


def _rare(joinable, hot):
    """mapInArrow body: (rid, text) to the units of each row that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), SLICE):
                u = Units(data, off, joinable.value)
                far = np.flatnonzero(hot.value.find(u.uid) < 0)
                row = np.searchsorted(u.first, far, "right") - 1
                order = np.lexsort((u.uid[far], row))
                row, uid = row[order], u.uid[far][order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (uid[1:] != uid[:-1])
                own = batch.select(["rid"]).take(pa.array(row[new] + i)).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array(uid[new])], names=["rid", "uid"])

    return run


def _assembler(joinable, hot, spelling):
    """mapInArrow body: (doc_id, packed text, rare: array of (uid, ids)) to piece ids and a digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            packed, sizes = batch.column("packed").to_pylist(), batch.column("size").to_numpy()
            rare = batch.column("rare")
            i = 0
            while i < batch.num_rows:
                j, total = i, 0
                while j < batch.num_rows and (j == i or total + sizes[j] <= SLICE):
                    total += int(sizes[j])
                    j += 1
                raw = [codec.decompress(p, int(n)).to_pybytes() if n else b"" for p, n in zip(packed[i:j], sizes[i:j])]
                off = np.concatenate([[0], np.cumsum(sizes[i:j].astype(np.int64))])
                u = Units(np.frombuffer(b"".join(raw), np.uint8), off, joinable.value)
                own = rare.slice(i, j - i).flatten()
                far = own.field("uid").to_numpy()
                _, once = np.unique(far, return_index=True)
                few = own.take(pa.array(once))
                extra = Lookup(few.field("uid").to_numpy(), _list_of(few.field("ids")))
                place, other = hot.value.find(u.uid), extra.find(u.uid)
                if (missing := (place < 0) & (other < 0)).any():
                    raise KeyError(f"{int(missing.sum())} units without an encoding")
                near = place >= 0
                count, start = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
                count[near], start[near] = hot.value.count[place[near]], hot.value.start[place[near]]
                count[~near], start[~near] = extra.count[other[~near]], extra.start[other[~near]] + len(hot.value.flat)
                stop = np.cumsum(count)
                at = np.repeat(start - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)
                split = len(hot.value.flat)
                ids = np.where(at < split, hot.value.flat[np.minimum(at, max(split - 1, 0))] if split else 0,
                               extra.flat[np.maximum(at - split, 0)] if len(extra.flat) else 0).astype(np.int32)
                ends = np.concatenate([[0], stop])[u.first]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in spelling.value.texts(lists)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(ends)), lists, pa.array(digests, pa.string())],
                                                 names=["doc_id", "n_pieces", "ids", "decoded_sha256"])
                i = j

    return run


def _zstd(text: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", compression_level=3)
    return pa.array([codec.compress(t.as_py().encode(), asbytes=True) for t in text], pa.binary())


pack = F.arrow_udf(_zstd, T.BinaryType())


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, hot_units: int = HOT_UNITS) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256) for every row of `docs`; the digest is of the text that the ids decode to."""
    vocabulary = vocabulary or Vocabulary.load()
    spark = docs.sparkSession
    words = checkpointed(units(docs, vocabulary))
    codes = checkpointed(encode_units(words, vocabulary))
    # The most frequent units, so many a bucket; buckets are even since they go by hash.
    buckets = 64
    order = Window.partitionBy(F.pmod("uid", F.lit(buckets))).orderBy(F.desc("n"), "uid")
    top = words.filter(F.char_length("unit") <= HOT_CHARS).select("uid", F.row_number().over(order).alias("nth")).filter(F.col("nth") <= hot_units // buckets)
    near = codes.join(top.select("uid"), "uid").toArrow()
    hot = spark.sparkContext.broadcast(Lookup(near.column("uid").to_numpy(), _list_of(near.column("ids"))))
    joinable = spark.sparkContext.broadcast(Cuts.of(vocabulary))

    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A row's number only has to bring its units to it: should two rows share one, each gets some it does not need.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), body).alias("rid"), body.alias("text"))
    rare = keyed.select("rid", "text").mapInArrow(_rare(joinable, hot), "rid long, uid long").join(codes.hint("merge"), "uid")
    rare = rare.groupBy("rid").agg(F.collect_list(F.struct("uid", "ids")).alias("rare"))
    packed = keyed.select("doc_id", "rid", pack("text").alias("packed"), F.octet_length("text").alias("size"))
    none = F.array().cast("array<struct<uid: bigint, ids: array<int>>>")
    both = packed.join(rare.hint("merge"), "rid", "left").select("doc_id", "packed", "size", F.coalesce("rare", none).alias("rare"))
    spelling = spark.sparkContext.broadcast(Spelling.of(vocabulary))
    return both.mapInArrow(_assembler(joinable, hot, spelling), "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string")


def decoder(spark: SparkSession, vocabulary: Vocabulary | None = None):
    """A column function from piece ids to text; unknown pieces come out as the usual mark."""
    shared = spark.sparkContext.broadcast(Spelling.of(vocabulary or Vocabulary.load()))

    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([t for i in range(0, len(ids), 128) for t in shared.value.texts(ids.slice(i, 128))], pa.string())

    return F.arrow_udf(decode, T.StringType())
