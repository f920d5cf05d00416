"""Tree of cells over points: tight boxes that are dropped or opened before any points meet.

A cell of level L is a cube of `size * 4^L`, so a cell has at most 64 children and no join with the tree multiplies a row by
more. Cells that hold many points are split further until few are left in each, so a crowded place costs levels and no large
key. Joins of candidates with the tree may have hot keys on the side of the candidates only, which AQE can split.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.session import checkpointed

XYZ = ("x", "y", "z")
KEY = ("_cx", "_cy", "_cz")
BOX = tuple(f"_{end}_{c}" for c in XYZ for end in ("lo", "hi"))
#: Level at which splitting ends; cells are then 1e-12 of the first size, and what they hold lies at one place for doubles.
DEEPEST = -20


def finite(names=XYZ) -> Column:
    return reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in names])


@dataclass
class CellTree:
    """`nodes`: (by, _level, cell, _leaf, box); `points`: the rows with level and cell of the leaf they lie in."""

    nodes: DataFrame
    points: DataFrame
    top: int
    bottom: int
    #: Highest level with leaves.
    first_leaf: int
    by: str

    def level(self, level: int) -> DataFrame:
        return self.nodes.filter(F.col("_level") == level)

    def opened(self, found: DataFrame, level: int) -> DataFrame:
        """The children of the cells of a level in `found` that are no leaves, with the other columns of `found`."""
        up = [k.replace("_c", "_p") for k in KEY]
        kids = self.level(level - 1).withColumns({p: F.shiftright(k, 2) for k, p in zip(KEY, up)})
        outer = found.filter(~F.col("_leaf")).drop("_level", "_leaf", *BOX).withColumnsRenamed(dict(zip(KEY, up)))
        return outer.join(kids, [self.by, *up]).drop(*up)

    def leaves(self, found: DataFrame, level: int, keep) -> DataFrame:
        """Opens cells from `level` down, keeping those that `keep` returns, and gives the leaves that are left."""
        parts, found = [], keep(found)
        while level > self.bottom:
            if level <= self.first_leaf:
                found = checkpointed(found)
                parts.append(found.filter("_leaf"))
            found = keep(self.opened(found, level))
            level -= 1
        return reduce(DataFrame.unionByName, [*parts, found.filter("_leaf")])


def _placed(d: DataFrame, size: float, level: int) -> DataFrame:
    cells = {k: F.floor(F.col(c) / (size * 4.0**level)) for c, k in zip(XYZ, KEY)}
    return d.withColumns({"_level": F.lit(level), **cells})


def _summary(d: DataFrame, by: str) -> DataFrame:
    ends = [f(c).alias(f"_{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    return checkpointed(d.groupBy(by, "_level", *KEY).agg(F.count(F.lit(1)).alias("_n"), *ends))


def build(points: DataFrame, by: str, size: float, leaf: int, upper: bool = True, shallow: bool = False) -> CellTree:
    """The tree over `points` (x, y, z and any other columns), from cells of `size`.

    Cells with more than `leaf` points are split. `upper` adds the levels above, up to at most eight cells a key. With
    `shallow` also a larger cell is a leaf if it holds few points. Points without finite coordinates are left out.
    """
    held = checkpointed(_placed(points.filter(finite()), size, 0))
    cells = _summary(held, by)
    full = F.col("_n") > leaf
    top, nodes, parts = 0, [cells], []
    if upper:
        spread = cells.groupBy(by).agg(*[(F.shiftright(F.max(k), 1) - F.shiftright(F.min(k), 1)).alias(k) for k in KEY])
        widest = spread.agg(F.max(F.greatest(*KEY))).first()[0] or 0
        top = max(1, (int(widest).bit_length() + 2) // 2)
        above = cells.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(top))))
        above = above.withColumns({k: F.expr(f"shiftright({k}, 2 * _level)") for k in KEY})
        ends = [f(c).alias(c) for c, f in zip(BOX, (F.min, F.max) * 3)]
        nodes.append(checkpointed(above.groupBy(by, "_level", *KEY).agg(F.sum("_n").alias("_n"), *ends)))
    if upper and shallow:
        up = {f"_u{k}": F.expr(f"shiftright({k}, 2 * _level)") for k in KEY}
        sizes = cells.unionByName(nodes[1]).select(by, "_level", *[F.col(k).alias(f"_u{k}") for k in KEY], "_n")
        each = cells.select(by, *KEY, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level")).withColumns(up)
        each = each.join(sizes, [by, "_level", *up]).groupBy(by, *KEY).agg(F.max(F.when(~full, F.col("_level"))).alias("_at"))
        held = checkpointed(held.drop("_level").join(checkpointed(each), [by, *KEY]).withColumn("_level", F.coalesce("_at", F.lit(0))))
        lifted = {k: F.expr(f"shiftright({k}, 2 * _level)") for k in KEY}
        parts.append(held.filter("_at IS NOT NULL").withColumns(lifted).drop("_at"))
        held = held.filter("_at IS NULL").drop("_at")
    level = 0
    while level > DEEPEST and cells.filter(full).limit(1).count():
        dense = cells.filter(full).select(by, *KEY)
        if level or not shallow:
            parts.append(held.join(dense, [by, *KEY], "left_anti"))
        level -= 1
        held = checkpointed(_placed(held.join(dense, [by, *KEY], "left_semi"), size, level))
        cells = _summary(held, by)
        nodes.append(cells)
    parts.append(held)
    small = ~full | (F.col("_level") == DEEPEST)
    known = reduce(DataFrame.unionByName, nodes).withColumn("_leaf", small if shallow else small & (F.col("_level") <= 0)).drop("_n")
    return CellTree(known, reduce(DataFrame.unionByName, parts), top, level, top if shallow else 0, by)
