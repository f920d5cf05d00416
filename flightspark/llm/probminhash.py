"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles, a weight being the count of the shingle. Every shingle sends points
of a Poisson process with its weight as rate to random components; a component keeps the shingle whose point came first, and a
shingle stops when its next point is later than all that the components hold. Components agree with the probability Jaccard
similarity of two documents, or with their plain Jaccard similarity where all weights are one. Bands of components of both kinds
make buckets; documents without a repeated shingle have one signature, which is of both kinds.

Exact copies are merged first. In each bucket every document meets the two members that share most buckets with others, the
likely originals; buckets with few members meet whole. Candidates are verified on their texts, links are closed to classes. Members
of large buckets that are still in different classes are compared by an exact filter: shingles are ordered by how many of
these documents hold them, rare ones first, and two documents meet only on a shingle that stands so early in both that they can still
reach the limit. Copies of one text that differ in places of their own share the frequent shingles, which come late, so a family
alike just below the limit costs its pairs no more. No link between documents that share a bucket is lost.

Defined results: texts without a word are alike only if equal; a text of one to four words is one shingle; a null text counts as
empty; a null doc_id belongs to no class; rows with one id are one document with the links of all its texts; other columns are
not read by `classes` and pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightspark.llm.bytes_kit import WIDE_SLICE, Rolling, U64, Words, free_name, mix, per_row, slices
from flightspark.operators.scale import connected_components
from flightspark.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: Buckets of at most so many members are compared whole.
WHOLE = 6
_STEP = U64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted, of a slice; a row of fewer than k words has one shingle."""
    w = Words(data, off)
    roll = Rolling(w.hashes())
    g = roll.grams(k)
    ok = w.whole(k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    row = np.concatenate([w.row[: len(g)][ok], short])
    print_ = np.concatenate([g[ok], roll.of(w.first[short], w.first[short + 1])])
    order = np.lexsort((print_, row))
    row, print_ = row[order], print_[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (print_[1:] != print_[:-1])
    head = np.flatnonzero(new)
    return row[head], print_[head], np.diff(np.append(head, len(row)))


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """rows x m shingle hashes: the shingle whose point reached the component first."""
    first = np.full(rows * m, np.inf)
    out = np.zeros(rows * m, U64)
    left = np.zeros(rows, np.int64)
    has = np.zeros(rows, bool)
    has[row] = True
    left[has] = m
    x = np.zeros(len(row))
    state = item
    rate = 1.0 / weight
    while len(row):
        state = state + _STEP
        drawn = mix(state)
        x = x - np.log(((drawn >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) * rate
        slot = row * m + (mix(drawn) % U64(m)).astype(np.int64)
        np.minimum.at(first, slot, x)
        won = x == first[slot]
        out[slot[won]] = item[won]
        latest = first.reshape(rows, m).max(axis=1)
        go = x < latest[row]
        row, item, rate, x, state = row[go], item[go], rate[go], x[go], state[go]
    return out.reshape(rows, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands: a hash of the components of each band and its number."""
    sig = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), sig.shape[:2]).copy()
    for c in range(sig.shape[2]):
        key = mix(key * _STEP + sig[:, :, c])
    return key


def _banded(bands: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), WIDE_SLICE):
                row, item, count = shingles(data, off)
                if not len(row):
                    continue
                own, row = np.unique(row, return_inverse=True)
                plain = band_keys(signatures(row, item, np.ones(len(row)), len(own), bands * per), bands)
                # Equal weights give the signature of weights of one.
                first = np.searchsorted(row, np.arange(len(own)))
                heavy = np.zeros(len(own), bool)
                heavy[row[count != count[first][row]]] = True
                here = heavy[row]
                new = np.zeros((len(own), bands), bool)
                weighted = np.zeros((len(own), bands), U64)
                if here.any():
                    number = np.cumsum(heavy) - 1
                    weighted[heavy] = band_keys(signatures(number[row[here]], item[here], count[here], int(heavy.sum()), bands * per), bands)
                    new[heavy] = weighted[heavy] != plain[heavy]
                both = np.hstack([plain, weighted])
                kept = np.hstack([np.ones_like(new), new])
                ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(both[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own + i)), keys], names=["doc_id", "keys"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two weighted sets given as sorted elements and weights."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(a[0]) + len(b[0]) - len(both))
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    ratio = wa / wb
    only_a = a[1].sum() - wa.sum()  # ratio infinite: always on a's side
    only_b = b[1].sum() - wb.sum()  # ratio zero: always on b's side
    order = np.argsort(ratio, kind="stable")
    r, x, y = ratio[order], wa[order], wb[order]
    at = np.searchsorted(r, r, "left")
    below = np.concatenate([[0.0], np.cumsum(y)])[at]
    above = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[at]
    return float((1.0 / ((only_a + above) / x + (only_b + below) / y)).sum()), plain


def _verifier(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, keep = [], np.zeros(batch.num_rows, bool)
            left, right = batch.column("ta"), batch.column("tb")
            step = max(1, min(256, (4 << 20) // (1 + (left.nbytes + right.nbytes) // max(1, batch.num_rows))))
            for i in range(0, batch.num_rows, step):
                j = min(i + step, batch.num_rows)
                sets = []
                for col in (left, right):
                    own = []
                    for _, _, data, off in slices(col.slice(i, j - i)):
                        row, item, count = shingles(data, off)
                        cut = np.searchsorted(row, np.arange(len(off)))
                        own += [(item[p:q], count[p:q]) for p, q in zip(cut[:-1], cut[1:])]
                    sets.append(own)
                for k, (a, b) in enumerate(zip(*sets)):
                    s = max(similarity(a, b))
                    if s >= least:
                        good.append(s)
                        keep[i + k] = True
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(good, pa.float64())], names=["a", "b", "similarity"])

    return run


def buckets(docs: DataFrame, without: DataFrame, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """(key, doc_id, n, rank): the n members of each bucket of several, without the documents listed in `without`."""
    keys = docs.select("doc_id", "text").mapInArrow(_banded(bands, per), "doc_id long, keys array<long>")
    keys = checkpointed(keys.join(without.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti"))
    rows = keys.select("doc_id", F.explode("keys").alias("key"))
    # Small sides are written first: a join with a written table can be split where a bucket is hot.
    sizes = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = checkpointed(rows.join(sizes, "key").select("key", "doc_id", "n"))
    met = checkpointed(shared.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("met")))
    ranked = shared.join(met, "doc_id").select("key", "doc_id", "n", F.struct("met", -F.col("doc_id")).alias("rank"))
    return checkpointed(ranked)


def candidates(ranked: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, to be verified first."""
    # A small bucket needs all its members, a large one its first two.
    few = ranked.filter(F.col("n") <= WHOLE).groupBy("key").agg(F.collect_set("doc_id").alias("hubs"))
    large = ranked.filter(F.col("n") > WHOLE)
    top = checkpointed(large.groupBy("key").agg(F.max("rank").alias("top")))
    second = large.join(top, "key").filter(F.col("rank") < F.col("top")).groupBy("key").agg(F.max("rank").alias("next"))
    hubs = top.join(second, "key", "left").select("key", F.array_compact(F.array(-F.col("top.col2"), -F.col("next.col2"))).alias("hubs"))
    hubs = checkpointed(few.unionByName(hubs))
    met_by = ranked.select("key", "doc_id").join(hubs, "key").select("doc_id", F.explode("hubs").alias("hub")).filter("doc_id <> hub")
    return met_by.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def contested(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, class_id, left): members of large buckets that `groups` (doc_id, class_id) leaves in several classes; `left` if
    the document is outside the largest class of such a bucket."""
    large = ranked.filter(F.col("n") > WHOLE).select("key", "doc_id").join(groups, "doc_id", "left")
    large = checkpointed(large.select("key", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))
    sizes = large.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("m"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("m", "class_id")).alias("top"), F.sum("m").alias("n")).filter("top.m < n")
    tops = checkpointed(tops.select("key", F.col("top.class_id").alias("top")))
    return large.join(tops, "key").groupBy("doc_id", "class_id").agg(F.max(F.col("class_id") != F.col("top")).alias("left"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in slices(batch.column("text")):
            row, item, count = shingles(data, off)
            ends = np.searchsorted(row, np.arange(j - i + 1))
            cols = [batch.column(c).slice(i, j - i) for c in ("doc_id", "class_id", "left", "h")]
            cols += [pa.array(per_row(v, ends)) for v in (np.ones(len(row), np.int64), count)]
            heavy = count != count[np.minimum(ends[:-1], max(0, len(row) - 1))][row] if len(row) else np.zeros(0, bool)
            cols.append(pa.array(per_row(heavy, ends) > 0))
            cols += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int64))) for v in (item.view(np.int64), count)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "class_id", "left", "h", "size", "total", "heavy", "items", "counts"])


def prefixes(docs: DataFrame, members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The first shingles of `members` in one order of all shingles, rare ones first, as far as a partner has to share one of them.

    Two sets that reach `least` have overlap/(sum of sizes) of at least least/(1 + least), so their first common shingle has at
    least that overlap behind it in both. A term of the probability Jaccard is at most the share of either side, so before their
    first common shingle neither side has a share of more than 1 - least. (item, doc_id, class_id, left, size, pos, lead, heavy).
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(checkpointed(members).hint("merge"), "doc_id")
    sets = checkpointed(texts.select("doc_id", "class_id", "left", "h", "text").mapInArrow(
        _sets, "doc_id long, class_id long, left boolean, h long, size long, total long, heavy boolean, items array<long>, counts array<long>"))
    # Shingles of one text only come before all others and can be shared with none.
    often = checkpointed(sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"))
    # Only numbers travel with each shingle: what is computed from the arrays has been before.
    each = sets.select("doc_id", "class_id", "left", "h", "size", "total", "heavy", F.explode(F.arrays_zip("items", "counts")).alias("e"))
    each = each.select("*", F.col("e.items").alias("item"), F.col("e.counts").alias("c")).drop("e")
    own = Window.partitionBy("doc_id", "h")
    upto = own.orderBy("f", "item").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.join(often, "item").select(
        "*", (F.col("size") - F.count(F.lit(1)).over(own) + F.count(F.lit(1)).over(upto) - 1).alias("pos"),
        ((F.col("total") - F.sum("c").over(own) + F.sum("c").over(upto) - F.col("c")) / F.col("total")).alias("lead"))
    reach = (F.col("pos") <= F.col("size") * (1 - least) + 1e-6) | (F.col("lead") <= 1 - least + 1e-9)
    return placed.filter(reach).select("item", "doc_id", "class_id", "left", "size", "pos", "lead", "heavy")


def rest(docs: DataFrame, ranked: DataFrame, groups: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a < b, of contested members in different classes that share a shingle early enough to reach `least`; one of
    the two is outside the largest class of a bucket. All such pairs are found, whether they share that bucket or not."""
    near = checkpointed(prefixes(docs, contested(ranked, groups), least))
    names = ("doc_id", "class_id", "left", "size", "pos", "lead", "heavy")
    right = near.select("item", *[F.col(c).alias("r_" + c) for c in names])
    new = (F.col("class_id") != F.col("r_class_id")) & (~F.col("r_left") | (F.col("doc_id") < F.col("r_doc_id")))
    overlap = (F.col("size") + F.col("r_size")) * (least / (1 + least)) - 1e-6
    plain = (F.col("pos") + overlap <= F.col("size")) & (F.col("r_pos") + overlap <= F.col("r_size"))
    share = (F.col("lead") <= 1 - least + 1e-9) & (F.col("r_lead") <= 1 - least + 1e-9)
    left = near.filter("left")
    met = [left.join(right, (left["item"] == right["item"]) & new & plain),
           # Without repeated shingles both similarities are one; only pairs with a heavy side need the other bound.
           left.filter("heavy").join(right, (left["item"] == right["item"]) & new & share),
           left.join(right.filter("r_heavy"), (left["item"] == right["item"]) & new & share)]
    pairs = [m.select(F.least("doc_id", "r_doc_id").alias("a"), F.greatest("doc_id", "r_doc_id").alias("b")) for m in met]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def links(docs: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs that reach `least`, by their texts."""
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # The same plan at every size: the texts are dealt by id, however few of them are wanted.
    texts = checkpointed(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id"))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verifier(least), "a long, b long, similarity double")


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_links): one row per id; class_id is the least id of the class, n_links counts verified links of the
    first of its exact copies (of the pairs that were compared: members of one class need not all meet)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.filter("doc_id IS NOT NULL")
    narrow = checkpointed(known.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    first = checkpointed(narrow.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    copies = checkpointed(narrow.join(first, ["h1", "h2"]).filter("doc_id <> first").select("doc_id", "first").distinct())
    # Only the first of equal texts is compared.
    ranked = buckets(known, copies, bands, per)
    tried = checkpointed(candidates(ranked))
    near = checkpointed(links(known, tried, least))
    so_far = checkpointed(connected_components(near, [], "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")))
    more = checkpointed(links(known, rest(known, ranked, so_far, least).join(tried, ["a", "b"], "left_anti"), least))
    found = near.unionByName(more)
    edges = so_far.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).unionByName(more.select("a", "b"))
    edges = edges.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    groups = connected_components(edges, [], "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    degree = found.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    ids = narrow.select("doc_id").distinct()
    out = ids.join(groups, "doc_id", "left").join(degree, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """`docs` with the least id of each class, once; rows without an id stay. Columns as they came."""
    key, nth = (free_name(docs.columns, c) for c in ("_stay", "_nth"))
    stay = classes(docs, least, bands, per).filter("doc_id = class_id").select(F.col("doc_id").alias(key))
    kept = docs.join(stay, F.col("doc_id").cast("long") == F.col(key)).drop(key)
    first = Window.partitionBy("doc_id").orderBy("text")
    once = kept.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)
    return once.unionByName(docs.filter("doc_id IS NULL"))
