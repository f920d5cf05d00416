"""Token counts that follow edits.

A text is cut into leaves of about a thousand bytes at places where every pre-tokenizer split falls in any context: between a
letter and a space that a letter follows. Tokens never cross such a place, so a document's count is the sum over its leaves. The
counts are kept in a segment tree per document: node 1 is the root, the children of node i are 2i and 2i + 1, leaves come last.

An edit replaces a stretch of bytes. Only the leaves it touches and one neighbour on either side are read and encoded again; all
other leaves keep their counts. If the number of leaves stays within the tree's width only the sums above changed leaves are added
up anew, otherwise the tree is laid out again from the leaf counts, still without encoding anything else.

Defined results: null and empty texts have no leaf and no token; edits are given in bytes of the old text, sorted by start; one that
is null, starts after the text's end, or overlaps an earlier one raises; bounds inside a character raise when the text is decoded;
a null doc_id is counted but can't be edited; repeated rows each get the edits of their id; other columns pass through.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightspark.llm.bytes_kit import free_name, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_BYTES = 1024
TREE = T.StructType([T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("nodes", T.ArrayType(T.IntegerType()))])
EDITED = T.StructType([T.StructField("text", T.StringType()), T.StructField("tree", TREE), T.StructField("leaves", T.IntegerType()), T.StructField("encoded", T.IntegerType()),
                       T.StructField("encoded_bytes", T.LongType())])
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

_ENCODINGS: dict[str, object] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A byte-pair vocabulary, sent to the tasks as bytes; each worker builds it once."""

    ranks: bytes
    name: str

    @staticmethod
    def load(path: str = RANKS) -> Tokenizer:
        with open(path, "rb") as f:
            return Tokenizer(f.read(), path)

    def encoding(self):
        if self.name not in _ENCODINGS:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            _ENCODINGS[self.name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _ENCODINGS[self.name]


def cut_places(data: np.ndarray) -> np.ndarray:
    """Bytes before which a text may be cut: a space between two ASCII letters. Either side then splits as it does in the whole."""
    out = np.zeros(len(data), bool)
    if len(data) > 2:
        out[1:-1] = (data[1:-1] == 32) & _LETTER[data[:-2]] & _LETTER[data[2:]]
    return np.flatnonzero(out)


def leaf_ends(data: np.ndarray, leaf: int = LEAF_BYTES) -> list[int]:
    """End of each leaf: the first place at least `leaf` bytes after the last one."""
    n, places = len(data), cut_places(data)
    ends, at = [], 0
    while n - at > leaf:
        k = int(np.searchsorted(places, at + leaf))
        if k == len(places):
            break
        at = int(places[k])
        ends.append(at)
    return ends + [n] if n else []


def grow(counts: list[int]) -> list[int]:
    """Segment tree over leaf counts: 2w numbers for the least power of two w that holds them, the first unused."""
    width = 1
    while width < len(counts):
        width *= 2
    nodes = np.zeros(2 * width, np.int64)
    nodes[width: width + len(counts)] = counts
    level = width
    while level > 1:
        nodes[level // 2: level] = nodes[level: 2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return nodes.tolist() if counts else []


def patch(nodes: list[int], changed: dict[int, int]) -> list[int]:
    """New sums above the changed leaves only."""
    nodes, width = list(nodes), len(nodes) // 2
    dirty = set()
    for leaf, count in changed.items():
        nodes[width + leaf] = count
        dirty.add((width + leaf) // 2)
    while dirty:
        for i in dirty:
            if i:
                nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
        dirty = {i // 2 for i in dirty if i > 1}
    return nodes


def _tokens(encoding, parts: list[bytes]) -> list[int]:
    return [len(encoding.encode_ordinary(p.decode())) for p in parts]


def build(spark: SparkSession, tokenizer: Tokenizer | None = None, leaf: int = LEAF_BYTES):
    """A column function from a text to its tree (leaf ends and nodes)."""
    shared = spark.sparkContext.broadcast(tokenizer or Tokenizer.load())

    def run(text: pa.Array) -> pa.Array:
        encoding = shared.value.encoding()
        ends, nodes = [], []
        for _, _, data, off in slices(text):
            raw = data.tobytes()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                own = leaf_ends(data[a:b], leaf)
                ends.append(own)
                nodes.append(grow(_tokens(encoding, [raw[a + x: a + y] for x, y in zip([0, *own], own)])))
        return pa.StructArray.from_arrays([pa.array(ends, pa.list_(pa.int32())), pa.array(nodes, pa.list_(pa.int32()))], ["ends", "nodes"])

    return F.arrow_udf(run, TREE)


@dataclass
class Edited:
    text: bytes
    ends: list[int]
    nodes: list[int]
    encoded: int
    encoded_bytes: int


def apply_edits(text: bytes, ends: list[int], nodes: list[int], edits: list[tuple[int, int, bytes]], encoding, leaf: int = LEAF_BYTES) -> Edited:
    """The text and tree after the edits (start, end, replacement)."""
    if not edits:
        return Edited(text, ends, nodes, 0, 0)
    width = len(nodes) // 2
    done = 0
    for start, end, _ in edits:
        if start is None or end is None or not done <= start <= end <= len(text):
            raise ValueError(f"edit {start}..{end} is out of order or beyond {len(text)} bytes")
        done = end
    old_counts = nodes[width: width + len(ends)]
    bounds = np.array([0, *ends])
    # Stretches of leaves that edits touch, with a neighbour on either side, since a cut may vanish next to the edit.
    groups: list[list] = []
    for e in edits:
        lo = max(0, int(np.searchsorted(bounds, e[0], "right")) - 2)
        hi = min(len(ends), int(np.searchsorted(bounds, e[1], "left")) + 1)
        if groups and lo <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], hi)
            groups[-1][2].append(e)
        else:
            groups.append([lo, hi, [e]])
    out, new_ends, counts, changed, at = [], [], [], {}, 0
    encoded = encoded_bytes = size = 0
    aligned = True
    for lo, hi, own in groups:
        a, b = int(bounds[lo]), int(bounds[hi])
        kept = text[int(bounds[at]): a]
        new_ends += [size + int(x) - int(bounds[at]) for x in ends[at:lo]]
        counts += old_counts[at:lo]
        out.append(kept)
        size += len(kept)
        pieces, last = [], a
        for start, end, put in own:
            pieces += [text[last:start], put]
            last = end
        part = b"".join([*pieces, text[last:b]])
        cuts = leaf_ends(np.frombuffer(part, np.uint8), leaf)
        fresh = _tokens(encoding, [part[x:y] for x, y in zip([0, *cuts], cuts)])
        if len(cuts) == hi - lo:
            changed |= {lo + k: c for k, c in enumerate(fresh)}
        else:
            aligned = False
        encoded += len(cuts)
        encoded_bytes += len(part)
        new_ends += [size + x for x in cuts]
        counts += fresh
        out.append(part)
        size += len(part)
        at = hi
    out.append(text[int(bounds[at]):])
    new_ends += [size + int(x) - int(bounds[at]) for x in ends[at:]]
    counts += old_counts[at:]
    return Edited(b"".join(out), new_ends, patch(nodes, changed) if aligned and nodes else grow(counts), encoded, encoded_bytes)


def recount(spark: SparkSession, tokenizer: Tokenizer | None = None, leaf: int = LEAF_BYTES):
    """A column function from (text, tree, edits: array of (start, end, put)) to the edited text, its tree, and what was encoded."""
    shared = spark.sparkContext.broadcast(tokenizer or Tokenizer.load())

    def run(text: pa.Array, tree: pa.Array, edits: pa.Array) -> pa.Array:
        encoding = shared.value.encoding()
        rows: list[list] = [[], [], [], [], [], []]
        for t, tr, es in zip(text, tree, edits):
            own = [(e["start"], e["end"], (e["put"] or "").encode()) for e in (es.as_py() or [])]
            raw = (t.as_py() or "").encode()
            r = apply_edits(raw, tr["ends"].as_py() or [], tr["nodes"].as_py() or [], own, encoding, leaf)
            for col, v in zip(rows, (r.text.decode(), r.ends, r.nodes, len(r.ends), r.encoded, r.encoded_bytes)):
                col.append(v)
        new_tree = pa.StructArray.from_arrays([pa.array(rows[1], pa.list_(pa.int32())), pa.array(rows[2], pa.list_(pa.int32()))], ["ends", "nodes"])
        return pa.StructArray.from_arrays([pa.array(rows[0], pa.string()), new_tree, pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.int64())],
                                          [f.name for f in EDITED.fields])

    return F.arrow_udf(run, EDITED)


def total(tree: str):
    """Tokens of a document: the root of its tree."""
    return F.coalesce(F.try_element_at(F.col(f"{tree}.nodes"), F.lit(2)), F.lit(0)).cast("long")


def with_counts(docs: DataFrame, tokenizer: Tokenizer | None = None, name: str = "_tree", leaf: int = LEAF_BYTES) -> DataFrame:
    """`docs` with the tree column `name`."""
    return docs.withColumn(name, build(docs.sparkSession, tokenizer, leaf)(F.col("text").cast("string")))


def follow(counted: DataFrame, edits: DataFrame, tokenizer: Tokenizer | None = None, name: str = "_tree", out: str = "_edited", leaf: int = LEAF_BYTES) -> DataFrame:
    """`counted` with the struct column `out` after the edits, a table (doc_id, start, end, put) in bytes of the old text.

    With a column `text_hash` (xxhash64) the edits are those of one text of the id."""
    key, own, of = (free_name(counted.columns, c) for c in ("_k", "_edits", "_of"))
    same = F.xxhash64(F.col("text").cast("string")) == F.col(of) if "text_hash" in edits.columns else F.lit(True)
    per = edits.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias(key), *([F.col("text_hash").alias(of)] if "text_hash" in edits.columns else []))
    per = per.agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias(own))
    none = F.array().cast("array<struct<start: int, end: int, put: string>>")
    both = counted.join(per.hint("merge"), (F.col("doc_id").cast("long") == F.col(key)) & same, "left")
    fn = recount(counted.sparkSession, tokenizer, leaf)
    return both.withColumn(out, fn(F.col("text").cast("string"), F.col(name), F.coalesce(own, none))).drop(key, own, of)


def _line_bounds(text: pa.Array) -> pa.Array:
    """Start and end byte of every line of each text, the line feed included."""
    ends, starts, stops = [0], [], []
    for t in text:
        raw = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and t.as_buffer().size else np.zeros(0, np.uint8)
        breaks = np.flatnonzero(raw == 10).astype(np.int32) + 1
        starts.append(np.concatenate([[0], breaks]))
        stops.append(np.concatenate([breaks, [len(raw)]]))
        ends.append(ends[-1] + len(starts[-1]))
    flat = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int32()) for c in (starts, stops)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end"]))


line_bounds = F.arrow_udf(_line_bounds, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))


def line_edits(docs: DataFrame) -> DataFrame:
    """Edits that take out each line standing earlier in its text word for word: (doc_id, text_hash, start, end, put).

    A line goes with the line feed after it, if it has one, so edits never overlap. Bounds of lines are found in one pass over the bytes.
    """
    body = F.col("text").cast("string")
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("t"))
    texts = texts.withColumn("l", F.split("t", "\n")).filter(F.size(F.array_distinct("l")) < F.size("l"))
    rows = texts.select("doc_id", "th", "l", line_bounds("t").alias("b")).select("doc_id", "th", F.explode(F.arrays_zip("l", "b")).alias("x"))
    seen = rows.groupBy("doc_id", "th", F.col("x.l").alias("line")).agg(F.collect_set("x.b").alias("spans")).filter("size(spans) > 1 AND line <> ''")
    later = seen.select("doc_id", "th", F.explode(F.slice(F.array_sort("spans"), 2, 1 << 30)).alias("x"))
    return later.select("doc_id", F.col("th").alias("text_hash"), "x.start", "x.end", F.lit("").alias("put"))
