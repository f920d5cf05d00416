"""Spatial grid: cell keys, radius and nearest joins, subsampling, per-cell aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightspark.functions import rotation as R
from flightspark.operators import celltree
from flightspark.operators.scale import attach, neighbour_offsets, range_chunks, reached_cells, shuffled, with_rank
from flightspark.session import checkpointed

FLIGHT = "flight_id"
XYZ = ("x", "y", "z")
CELL = ("cx", "cy", "cz")
#: Distinct target positions above which a cell is split.
LEAF = 256


def voxel_key(df: DataFrame, size: float, names: tuple[str, str, str] = ("gx", "gy", "gz")) -> DataFrame:
    return df.withColumns({g: F.floor(F.col(c) / size) for c, g in zip(XYZ, names)})


def _distance(prefix: str) -> Column:
    return R.norm([F.col(c) - F.col(prefix + c) for c in XYZ])


def neighbours(df: DataFrame, radius: int = 1) -> DataFrame:
    """Copies every row into its own and the surrounding cells (cx, cy, cz)."""
    d = df.withColumn("_o", F.explode(neighbour_offsets(radius)))
    return d.withColumns({c: F.col(c) + F.col(f"_o.o{c[1]}") for c in CELL}).drop("_o")


def radius_join(queries: DataFrame, elements: DataFrame, radius: float, query_id: str, element_id: str = "element_id",
                max_angle_deg: float | None = None, by: str = FLIGHT) -> DataFrame:
    """Pairs of queries and non-rejected elements within the radius (and normal cone), with their distance.

    Queries are copied to the cells they can reach, about eight of twice the radius; elements stay where they are.
    """
    normals = ("nx", "ny", "nz") if max_angle_deg is not None else ()
    q = shuffled(reached_cells(queries.select(by, query_id, *XYZ, *normals), radius, XYZ, CELL))
    live = elements.filter(F.col("state") != "REJECTED") if "state" in elements.columns else elements
    e = voxel_key(live, 2 * radius, CELL).select(by, *CELL, F.col(element_id).alias("e_id"), *[F.col(c).alias("e_" + c) for c in XYZ + normals])
    j = q.join(e, [by, *CELL]).withColumn("distance", _distance("e_")).filter(F.col("distance") <= radius)
    if normals:
        j = j.filter(R.dot([F.col(c) for c in normals], [F.col("e_" + c) for c in normals]) >= math.cos(math.radians(max_angle_deg)))
    return j.select(by, query_id, F.col("e_id").alias(element_id), "distance")


def nearest_neighbor(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str, first_radius: float,
                     max_radius: float | None = None, by: str = FLIGHT) -> DataFrame:
    """Nearest target of every query (by, query_id, target_id, distance), ties to the smallest id.

    Looks in the cells the first radius reaches for targets within it. Queries without one come down the tree of cells from
    its top; a cell is opened only if its box is not farther than some target of the query must be. Targets at one position
    are merged first, and crowded cells are split, so neither copies nor crowds multiply the pairs. Rows without finite
    coordinates have and are no neighbours.
    """
    limit = float("inf") if max_radius is None else max(first_radius, max_radius)
    merged = targets.groupBy(by, *XYZ).agg(F.min(target_id).alias(target_id))
    tree = celltree.build(merged, by, 2 * first_radius, LEAF, upper=limit > first_radius)
    q = checkpointed(queries.select(by, query_id, *XYZ).filter(celltree.finite()))
    around = shuffled(reached_cells(q, first_radius, XYZ, celltree.KEY))
    # Cells around that are leaves hold few targets and are compared at once; crowded ones are opened.
    meets = _distances(around.withColumn("_level", F.lit(0)), tree, first_radius, query_id, target_id)
    if tree.bottom < 0:
        crowds = around.join(tree.level(0).filter("NOT _leaf"), [by, *celltree.KEY])
        meets = meets.unionByName(_settled(crowds, tree, 0, first_radius, query_id, target_id))
    done = _nearest(meets, tree, query_id, target_id)
    if limit > first_radius:
        rest = checkpointed(shuffled(q).join(done, [by, query_id], "left_anti"))
        if rest.limit(1).count():
            far = _settled(rest.join(tree.level(tree.top), by), tree, tree.top, limit, query_id, target_id)
            done = done.unionByName(_nearest(far, tree, query_id, target_id))
    return done


def _distances(cells: DataFrame, tree: celltree.CellTree, limit: float, query_id: str, target_id: str) -> DataFrame:
    """Targets within the limit in the leaves that stand beside the queries."""
    t = tree.points.withColumnsRenamed({c: "t_" + c for c in XYZ})
    j = shuffled(cells).join(t, [tree.by, "_level", *celltree.KEY]).withColumn("distance", _distance("t_")).filter(F.col("distance") <= limit)
    return j.select(tree.by, query_id, target_id, "distance")


def _nearest(meets: DataFrame, tree: celltree.CellTree, query_id: str, target_id: str) -> DataFrame:
    best = meets.groupBy(tree.by, query_id).agg(F.min(F.struct("distance", target_id)).alias("_b"))
    return checkpointed(best.select(tree.by, query_id, f"_b.{target_id}", "_b.distance"))


def _settled(found: DataFrame, tree: celltree.CellTree, level: int, limit: float, query_id: str, target_id: str) -> DataFrame:
    """Targets within the limit that may be nearest, from the cells found at a level. Bounds are rounded as distances are, so
    ties stay."""
    near = R.norm([F.greatest(F.col("_lo_" + c) - F.col(c), F.col(c) - F.col("_hi_" + c), F.lit(0.0)) for c in XYZ])
    far = R.norm([F.greatest(F.abs(F.col(c) - F.col("_lo_" + c)), F.abs(F.col(c) - F.col("_hi_" + c))) for c in XYZ])
    one = Window.partitionBy(tree.by, query_id)

    def keep(d: DataFrame) -> DataFrame:
        return d.withColumn("_most", F.least("_most", F.min(far).over(one))).filter(near <= F.col("_most"))

    cells = tree.leaves(found.withColumn("_most", F.lit(limit)), level, keep).select(tree.by, query_id, *XYZ, "_level", *celltree.KEY)
    return _distances(cells, tree, limit, query_id, target_id)


def voxel_subsample(points: DataFrame, size: float, row_id: str, by: str = FLIGHT) -> DataFrame:
    """The first row of every voxel."""
    rest = [c for c in points.columns if c != by]
    first = F.min_by(F.struct(*rest), row_id)
    d = voxel_key(points, size, CELL).groupBy(by, *CELL).agg(first.alias("_r"))
    return d.select(by, "_r.*")


def stride_sample(points: DataFrame, order: list[str], limit: int, by: tuple[str, ...] = (FLIGHT, "frame_id")) -> DataFrame:
    """Every n-th point of frames with more than `limit` points."""
    by = list(by)
    d = with_rank(range_chunks(points, by, order), by, order, "_rank").drop("_chunk")
    d = attach(d, points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    stride = F.when(F.col("_n") > limit, F.ceil(F.col("_n") / limit)).otherwise(1)
    return d.filter(F.col("_rank") % stride == 0).drop("_rank", "_n")


def cell_aggregate(points: DataFrame, cell: float = 0.08, poses: DataFrame | None = None, by: str = FLIGHT) -> DataFrame:
    """One observation per (flight, frame, cell): confidence-weighted means, best confidence, unit normal and viewing ray.

    `points` has x..z, nx..nz, r, g, b, conf; `poses` has tx..tz per frame. Sums are combined before the shuffle.
    """
    w = F.greatest(F.lit(1e-3), F.col("conf"))
    cols = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b"]
    d = voxel_key(points, cell).groupBy(by, "frame_id", "gx", "gy", "gz").agg(
        F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(c) for c in cols], F.max("conf").alias("conf"))
    d = d.withColumns({c: F.col(c) / F.greatest(F.lit(1e-9), F.col("_w")) for c in cols}).drop("_w")
    d = d.withColumn("_n", F.greatest(F.lit(1e-12), R.norm([F.col(c) for c in ("nx", "ny", "nz")])))
    d = d.withColumns({c: F.col(c) / F.col("_n") for c in ("nx", "ny", "nz")}).drop("_n")
    if poses is None:
        return d.withColumns({f"ray_{a}": -F.col(f"n{a}") for a in XYZ})
    d = attach(d, poses.select(by, "frame_id", "tx", "ty", "tz"), [by, "frame_id"], compute_once=False)
    d = d.withColumns({f"ray_{a}": F.col(a) - F.col(f"t{a}") for a in XYZ})
    d = d.withColumn("_n", F.greatest(F.lit(1e-9), R.norm([F.col(f"ray_{a}") for a in XYZ])))
    return d.withColumns({f"ray_{a}": F.coalesce(F.col(f"ray_{a}") / F.col("_n"), -F.col(f"n{a}")) for a in XYZ}).drop("_n", "tx", "ty", "tz")
