"""Shared building blocks for ordered, ranked and keyed work on tables where one key may hold most rows.

Ordering a whole flight inside one window would put that flight into one task. Here the rows are first range-sorted
over all tasks by (key, order), so a large key is spread over many *chunks*; windows run inside (key, chunk) and only
one summary row per chunk travels between chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightspark.session import checkpointed

CHUNK = "_chunk"


def _names(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def range_chunks(df: DataFrame, by: Sequence[str] | str, order: Sequence[str] | str, chunks: int | None = None) -> DataFrame:
    """Adds `_chunk`: the range partition of the row in (by, order). Frozen by a checkpoint, so it is one fixed value.

    All rows of a chunk precede all rows of the next chunk in (by, order), and a key's rows may span many chunks. The plan
    is the same at every size.
    """
    by, order = _names(by), _names(order)
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in by + order])
    return checkpointed(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _spanning(summary: DataFrame, keep: Column) -> DataFrame:
    """Chunk summaries that carry something. Each chunk border lies in at most one key, so at most one row per chunk
    is left however many keys there are, which is what makes the broadcast safe."""
    return F.broadcast(summary.filter(keep))


def with_previous(chunked: DataFrame, by, order, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Adds the columns of the preceding row of the same key. `chunked` comes from `range_chunks`."""
    by, order = _names(by), _names(order)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    inner = chunked.withColumn("_lag", F.lag(F.struct(*cols)).over(w))
    tails = chunked.groupBy(*by, CHUNK).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail"))
    carry = tails.select(*by, CHUNK, F.lag("_tail").over(Window.partitionBy(*by).orderBy(CHUNK)).alias("_carry"))
    out = inner.join(_spanning(carry, F.col("_carry").isNotNull()), by + [CHUNK], "left")
    out = out.withColumn("_lag", F.coalesce("_lag", "_carry"))
    return out.select(*chunked.columns, *[F.col(f"_lag.{c}").alias(prefix + c) for c in cols])


def with_brackets(chunked: DataFrame, by, order, value: str) -> DataFrame:
    """Adds `_before` / `_after`: the last non-null `value` at or before the row and the first at or after it."""
    by, order = _names(by), _names(order)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    inner = (chunked.withColumn("_before", F.last(value, ignorenulls=True).over(back))
             .withColumn("_after", F.first(value, ignorenulls=True).over(ahead)))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = chunked.groupBy(*by, CHUNK).agg(F.min_by(value, known).alias("_first"), F.max_by(value, known).alias("_last"))
    wc = Window.partitionBy(*by).orderBy(CHUNK)
    carry = ends.select(
        *by, CHUNK,
        F.last("_last", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
        F.first("_first", ignorenulls=True).over(wc.rowsBetween(1, Window.unboundedFollowing)).alias("_ca"))
    out = inner.join(_spanning(carry, F.col("_cb").isNotNull() | F.col("_ca").isNotNull()), by + [CHUNK], "left")
    return out.select(*chunked.columns, F.coalesce("_before", "_cb").alias("_before"),
                      F.coalesce("_after", "_ca").alias("_after"))


def with_rank(chunked: DataFrame, by, order, name: str = "rank") -> DataFrame:
    """Adds the 0-based position of the row in its key."""
    by, order = _names(by), _names(order)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    sizes = chunked.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_m"))
    wc = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*by, CHUNK, F.sum("_m").over(wc).alias("_off"))
    out = chunked.withColumn("_rn", F.row_number().over(w) - 1)
    out = out.join(_spanning(carry, F.col("_off").isNotNull()), by + [CHUNK], "left")
    return out.select(*chunked.columns, (F.col("_rn") + F.coalesce("_off", F.lit(0))).cast("long").alias(name))


def with_running_sum(chunked: DataFrame, by, order, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the key before this one (exclusive)."""
    by, order = _names(by), _names(order)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy(*by, CHUNK).agg(F.sum(value).alias("_s"))
    wc = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*by, CHUNK, F.sum("_s").over(wc).alias("_off"))
    out = chunked.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    out = out.join(_spanning(carry, F.col("_off").isNotNull()), by + [CHUNK], "left")
    return out.select(*chunked.columns, (F.col("_in") + F.coalesce("_off", F.lit(0))).alias(name))


def ranked(df: DataFrame, by, order, name: str = "rank") -> DataFrame:
    """`with_rank` from scratch; `order` must be unique within `by` for a stable answer."""
    return with_rank(range_chunks(df, by, order), by, order, name).drop(CHUNK)


def exact_quantiles(df: DataFrame, by, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with linear-interpolated quantiles, without ever holding a key's values in one task.

    Equal values are merged before the sort, then ranks are found from chunk counts and in-chunk running counts.
    """
    by = _names(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    chunked = range_chunks(counted, by, "_v")
    totals = chunked.groupBy(*by).agg(F.sum("_n").alias("_tot"))
    running = with_running_sum(chunked, by, "_v", "_n", "_start").select(*by, "_v", "_n", "_start")
    ranks = running.join(totals, by) if by else running.crossJoin(F.broadcast(totals))
    aggs, outs = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("_start") <= at) & (at < F.col("_start") + F.col("_n"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_fr_{name}"))
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}")).alias(name))
    return ranks.groupBy(*by).agg(*aggs).select(*by, *outs)


def attach(df: DataFrame, small: DataFrame, on, how: str = "left", compute_once: bool = True) -> DataFrame:
    """Joins a lookup table. It is written first, so that Spark knows its size in bytes: within its broadcast limit the table
    is sent to all tasks, beyond it the join is a sort-merge join whose hot partitions can be split on the side of `df`."""
    return df.join(checkpointed(small) if compute_once else small, _names(on), how)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is dealt out by key and never sent whole to all tasks. Spark takes what an `explode` or a Python
    function gives, and what a well compressed table unpacks to, for no larger than the file it comes from."""
    return df.hint("merge")


#: Rows that a task takes where the number of tasks follows the table.
ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *by: Column | str, size: int | None = None) -> DataFrame:
    """`df`, which has about `rows` rows, dealt out by key to tasks of about `size` rows. The session's number of shuffle partitions, and the bytes
    of a well compressed file, do not follow the rows, so a task's sort or hash map would outgrow its memory and spill."""
    tasks = rows // (size or ROWS) + 1
    return df.repartition(tasks, *by) if tasks > 1 else df


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are worked out once a row. A filter on them stays above; Spark would copy their expressions into the condition of a
    join below as often as they are used, which makes a method that the JVM does not compile."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def strided(df: DataFrame, order: str, limit: int, by) -> DataFrame:
    """About `limit` rows of every key, evenly spaced in `order`; all rows of a key that has no more."""
    by = _names(by)
    d = with_rank(range_chunks(df, by, order), by, order, "_rank").drop(CHUNK)
    d = attach(d, d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / limit))
    return d.filter((F.col("_rank") % step == 0) & (F.col("_rank") / step < limit)).drop("_rank", "_n")


#: Edges that a task joins up at once.
PIECE = 1 << 18


def connected_components(edges: DataFrame, by: Sequence[str], a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(by, node, component) where component is the smallest node reachable over the undirected edges within `by`.

    Edges are sorted by (by, smaller end) over all tasks and joined up in pieces of bounded size, so keys and neighbourhoods that lie in
    one piece are done with at once. Nodes of several pieces link the least nodes of these, and such links are all that is left of the
    edges; they are joined up likewise as long as that halves them. What is left then is contracted by alternating large and small stars
    (O(log n) rounds in practice; it raises after `max_rounds`).
    """
    by = _names(by)
    pairs = checkpointed(edges.select(*by, F.col(a).alias("u"), F.col(b).alias("v")))
    whole = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in pairs.columns])
    links, left, levels, top = pairs.filter(whole), pairs.count(), [], None
    while top is None:
        named = checkpointed(_meeting(_contracted(links, by, left), by))
        levels.append(named.filter("_k = 1").select(*by, "node", F.col("_least").alias("component")))
        links = named.filter("_k > 1 AND root <> _least").select(*by, F.col("root").alias("u"), F.col("_least").alias("v"))
        before, left = left, links.count()
        if left == 0:
            top = levels.pop()
        elif left > PIECE and left * 2 > before:
            top = _starred(links, by, max_rounds)
    for level in reversed(levels):
        up = checkpointed(top).select(*by, F.col("node").alias("component"), F.col("component").alias("_top"))
        top = level.join(up, [*by, "component"], "left").select(*by, "node", F.coalesce("_top", "component").alias("component"))
    loose = pairs.filter(~whole)
    if loose.limit(1).count():
        # Edges without one end or key link nothing; their nodes stand alone unless another edge has them.
        top = checkpointed(top)
        alone = loose.select(*by, F.explode(F.array("u", "v")).alias("node")).distinct().join(top, [*by, "node"], "left_anti")
        top = top.unionByName(alone.withColumn("component", F.col("node")))
    return top


def _contracted(links: DataFrame, by: list[str], count: int) -> DataFrame:
    """(by, node, root) for every piece of the edges: the nodes it touches and the least node each reaches over it."""
    spark = links.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, count // PIECE + 1)) if count > PIECE else 1
    low = links.select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    dealt = (low.repartitionByRange(tasks, *by, "u") if tasks > 1 else low.coalesce(1)).sortWithinPartitions(*by, "u", "v")
    types = [links.schema[c].dataType for c in [*by, "u", "u"]]
    schema = T.StructType([T.StructField(c, t) for c, t in zip([*by, "node", "root"], types)])
    return dealt.mapInArrow(_join_up(by, PIECE), schema)


def _meeting(labels: DataFrame, by: list[str]) -> DataFrame:
    """Adds `_least`, the least root that the node has in any piece, and `_k`, the place of the row among the node's. A node has a row a
    piece at most."""
    w = Window.partitionBy(*by, "node").orderBy("root")
    return labels.withColumns({"_least": F.first("root").over(w), "_k": F.row_number().over(w)})


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers of the values in their order."""
    known = values.dictionary_encode()
    rank = np.empty(len(known.dictionary), np.int64)
    rank[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[known.indices.to_numpy()]


def _least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers 0..n-1 that each reaches over the edges."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != (up := label[label])).any():
            label = up
        apart = label[u] != label[v]
        u, v = label[u[apart]], label[v[apart]]
    return label


def _join_up(by: list[str], size: int):
    def piece(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        n = t.num_rows
        column = lambda c: pa.concat_arrays(t.column(c).chunks)
        ends = pa.concat_arrays([column("u"), column("v")])
        key = np.zeros(n, np.int64)
        for c in by:
            code = _codes(column(c))
            key = np.unique(key * (code.max() + 1) + code, return_inverse=True)[1].reshape(-1)
        code = _codes(ends)
        _, first, node = np.unique(np.concatenate([key, key]) * (code.max() + 1) + code, return_index=True, return_inverse=True)
        node = node.reshape(-1)
        root = _least_reached(node[:n], node[n:], len(first))
        return pa.RecordBatch.from_arrays([*[column(c).take(pa.array(first % n)) for c in by], ends.take(pa.array(first)), ends.take(pa.array(first[root]))],
                                          names=[*by, "node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held, rows = [*held, batch], rows + batch.num_rows
            if rows >= size:
                yield piece(held)
                held, rows = [], 0
        if held:
            yield piece(held)

    return run


def _starred(pairs: DataFrame, by: list[str], max_rounds: int) -> DataFrame:
    """Components by star contraction. Minima are combined before each shuffle, and the join with them can be split on a hub's side. A round
    is cut by one written table, and the end is seen from the number of its edges and the sum of their hashes."""
    nodes = pairs.select(*by, F.explode(F.array("u", "v")).alias("node")).distinct()
    current = checkpointed(_ordered(pairs, by))
    seen = _digest(current)
    for _ in range(max_rounds):
        current = checkpointed(_star(_star(current, by, large=True), by, large=False))
        before, seen = seen, _digest(current)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.join(roots, by + ["node"], "left")
    return out.select(*by, "node", F.coalesce("component", "node").alias("component"))


def _digest(pairs: DataFrame) -> tuple:
    hashed = F.xxhash64(*pairs.columns).cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def _ordered(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct edges pointing from the larger to the smaller end."""
    return (pairs.filter(F.col("u") != F.col("v"))
            .select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _star(pairs: DataFrame, by: list[str], large: bool) -> DataFrame:
    """One contraction: link the larger (or the smaller) neighbours of every node to the least node around it."""
    if large:
        around = pairs.unionByName(pairs.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs
    # Written, so that the join can be split where a hub has most edges.
    least = checkpointed(around.groupBy(*by, "u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = around.join(least, by + ["u"])
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(*by, "u", F.col("m").alias("v")))
    return _ordered(moved, by)


def reached_cells(df: DataFrame, radius: float, at: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Copies every row into the cells of `2 * radius` that hold places within the radius of it: two along each axis, rarely three.

    The reach is a little longer than the radius, so that rounding loses no place whose computed distance is within it.
    """
    for c, n in zip(at, names):
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(c) * 1e-15
        ends = [F.floor(end / (2 * radius)) for end in (F.col(c) - reach, F.col(c) + reach)]
        df = df.withColumn(n, F.explode(F.sequence(*ends)))
    return df


def neighbour_offsets(radius: int, dims: int = 3) -> Column:
    """Array of structs with the (2r+1)^dims cell offsets; a literal of fixed size."""
    spans = [range(-radius, radius + 1)] * dims
    cells = reduce(lambda acc, s: [p + (d,) for p in acc for d in s], spans, [()])
    names = ("ox", "oy", "oz")[:dims]
    return F.array(*[F.struct(*[F.lit(d).cast("long").alias(n) for d, n in zip(cell, names)]) for cell in cells])
