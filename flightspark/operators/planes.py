"""Dominant planes, structural regularisation and gap filling, ground levelling, boundary continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightspark.functions import rotation as R
from flightspark.operators.evidence import candidate_views
from flightspark.operators.grid import nearest_neighbor, radius_join
from flightspark.operators.scale import attach, exact_quantiles, range_chunks, strided, with_rank
from flightspark.session import checkpointed

FLIGHT = "flight_id"
XYZ = ("x", "y", "z")
N = ("nx", "ny", "nz")
ARCHITECTURE = ["facade", "roof", "building"]


def plane_ransac(points: DataFrame, point_id: str, threshold: float = 0.08, hypotheses: int = 150, shuffle: Column | None = None, min_points: int = 10) -> DataFrame:
    """Best supported plane n.p + d = 0 of each flight (nx, ny, nz, d, inliers), the first of equals.

    Triples are taken from the points in hashed order (or in the order of `shuffle`), so the draw is repeatable. Only the
    first few hundred points leave their tasks; every point then meets the hypotheses of its flight and is counted in place.
    """
    key = shuffle if shuffle is not None else F.xxhash64(point_id)
    p = points.select(FLIGHT, point_id, *XYZ)
    w = Window.partitionBy(FLIGHT).orderBy("_h", point_id)
    drawn = p.withColumn("_h", key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 3 * hypotheses).withColumn("_r", F.col("_r") - 1)
    drawn = drawn.withColumns({"hyp": F.floor(F.col("_r") / 3), "_k": F.col("_r") % 3})
    tri = drawn.groupBy(FLIGHT, "hyp").agg(*[F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in XYZ], F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 3)
    sub = lambda k: [F.col(f"{c}{k}") - F.col(f"{c}0") for c in XYZ]
    tri = tri.withColumns({"_" + n: c for n, c in zip(N, R.cross(sub(1), sub(2)))})
    tri = tri.withColumn("_len", R.norm([F.col("_" + n) for n in N])).filter(F.col("_len") >= 1e-6)
    tri = tri.select(FLIGHT, "hyp", *[(F.col("_" + n) / F.col("_len")).alias(n) for n in N], "x0", "y0", "z0")
    tri = tri.select(FLIGHT, "hyp", *N, (-(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0"))).alias("d"))
    size = points.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= min_points)
    hyp = checkpointed(tri)
    near = F.abs(R.dot([F.col(n) for n in N], [F.col(c) for c in XYZ]) + F.col("d")) < threshold
    votes = attach(p, hyp, FLIGHT, "inner", compute_once=False).filter(near).groupBy(FLIGHT, "hyp").agg(F.count(F.lit(1)).alias("inliers"))
    best = votes.groupBy(FLIGHT).agg(F.max_by(F.struct("hyp", "inliers"), F.struct("inliers", -F.col("hyp"))).alias("_b")).select(FLIGHT, "_b.*")
    return best.join(hyp, [FLIGHT, "hyp"]).join(size, FLIGHT)


def architectural_plane(surfels: DataFrame, threshold: float = 0.06, min_inliers: int = 40, hypotheses: int = 200, shuffle: Column | None = None) -> DataFrame:
    """Plane of each flight's architectural surfels; a wall is made vertical and led through its centroid (adds facade)."""
    arch = checkpointed(surfels.filter(F.col("semantic_class").isin(ARCHITECTURE)))
    pl = checkpointed(plane_ransac(arch, "element_id", threshold, hypotheses, shuffle).filter((F.col("inliers") >= min_inliers) & (F.col("points") >= min_inliers)))
    near = F.abs(R.dot([F.col("p_" + n) for n in N], [F.col(c) for c in XYZ]) + F.col("p_d")) < threshold
    inl = attach(arch.select(FLIGHT, "element_id", *XYZ), pl.select(FLIGHT, *[F.col(c).alias("p_" + c) for c in (*N, "d")]), FLIGHT, "inner", compute_once=False).filter(near)
    mean = inl.groupBy(FLIGHT).agg(*[F.avg(c).alias("_c" + c) for c in XYZ])
    d = pl.join(mean, FLIGHT).withColumn("facade", F.abs("nz") < 0.4)
    flat = F.greatest(F.lit(1e-6), F.hypot("nx", "ny"))
    d = d.withColumns({"_ux": F.col("nx") / flat, "_uy": F.col("ny") / flat})
    return d.select(FLIGHT, "facade", "inliers", *[F.col(c).alias("fit_" + c) for c in (*N, "d")], F.when(F.col("facade"), F.col("_ux")).otherwise(F.col("nx")).alias("nx"),
                    F.when(F.col("facade"), F.col("_uy")).otherwise(F.col("ny")).alias("ny"), F.when(F.col("facade"), 0.0).otherwise(F.col("nz")).alias("nz"),
                    F.when(F.col("facade"), -(F.col("_ux") * F.col("_cx") + F.col("_uy") * F.col("_cy"))).otherwise(F.col("d")).alias("d"))


def _with_plane(surfels: DataFrame, planes: DataFrame, threshold: float) -> DataFrame:
    d = attach(surfels, planes.select(FLIGHT, *[F.col(c).alias("p_" + c) for c in (*N, "d", "fit_nx", "fit_ny", "fit_nz", "fit_d")], "facade"), FLIGHT)
    on = F.col("semantic_class").isin(ARCHITECTURE) & (F.abs(R.dot([F.col("p_fit_" + n) for n in N], [F.col(c) for c in XYZ]) + F.col("p_fit_d")) < threshold)
    return d.withColumn("on_plane", F.coalesce(on, F.lit(False)))


def plane_regularize(surfels: DataFrame, planes: DataFrame, threshold: float = 0.06) -> DataFrame:
    """Surfels on their flight's plane take its normal and move half-way to it (adds on_plane)."""
    d = _with_plane(surfels, planes, threshold)
    d = d.withColumn("_dist", R.dot([F.col("p_" + n) for n in N], [F.col(c) for c in XYZ]) + F.col("p_d"))
    new = {c: F.when(F.col("on_plane"), F.col(c) - F.col("p_" + n) * F.col("_dist") * 0.5).otherwise(F.col(c)) for c, n in zip(XYZ, N)}
    new |= {n: F.when(F.col("on_plane"), F.col("p_" + n)).otherwise(F.col(n)) for n in N}
    return d.withColumns(new).select(*surfels.columns, "on_plane")


def plane_gap_fill(surfels: DataFrame, planes: DataFrame, voxel: float, threshold: float = 0.06, near: float = 0.08, far: float = 1.5, limit: int | None = None) -> DataFrame:
    """New surfels in the gaps of each flight's plane: grid cells whose nearest surfel is neither here nor far away.

    All of them, or the first `limit` of each flight in grid order. Cells are measured against `surfels` as they are given:
    regularise them first to follow the structural stage.
    """
    inl = _with_plane(surfels, planes, threshold).filter("on_plane")
    flat = F.hypot("p_nx", "p_ny")
    inl = inl.withColumns({"_ux": F.when(flat < 1e-4, 1.0).otherwise(F.col("p_ny") / flat), "_uy": F.when(flat < 1e-4, 0.0).otherwise(-F.col("p_nx") / flat), "_uz": F.lit(0.0)})
    axis = R.cross([F.col("p_" + n) for n in N], [F.col("_u" + c) for c in XYZ])
    inl = inl.withColumns({"_v" + c: e for c, e in zip(XYZ, axis)})
    inl = inl.withColumns({k: R.dot([F.col(f"_{k}{c}") for c in XYZ], [F.col(c) for c in XYZ]) for k in "uv"})
    frame = ["p_nx", "p_ny", "p_nz", "p_d", "facade", *[f"_{k}{c}" for k in "uv" for c in XYZ]]
    box = checkpointed(inl.groupBy(FLIGHT, *frame).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), *[F.avg(c).alias(c) for c in "rgb"]))
    step = voxel * 1.5
    # An extent of a whole number of steps must not gain a cell by rounding.
    count = lambda k: F.greatest(F.lit(0), F.ceil((F.col(k + "1") - F.col(k + "0")) / step - 1e-9)).cast("long")
    cell = box.withColumns({"_nu": count("u"), "_nv": count("v")}).filter((F.col("_nu") > 0) & (F.col("_nv") > 0))
    cell = cell.withColumn("iu", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nu") - 1))).withColumn("iv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nv") - 1)))
    at = {c: (F.col("u0") + F.col("iu") * step) * F.col("_u" + c) + (F.col("v0") + F.col("iv") * step) * F.col("_v" + c) - F.col("p_d") * F.col("p_" + n) for c, n in zip(XYZ, N)}
    cell = checkpointed(cell.withColumns(at).withColumn("cell", F.col("iu") * F.col("_nv") + F.col("iv")).select(FLIGHT, "cell", *XYZ, "facade", "p_nx", "p_ny", "p_nz", "r", "g", "b"))
    gap = nearest_neighbor(cell, surfels.filter(F.col("state") != "REJECTED"), "cell", "element_id", max(near, voxel), max_radius=far)
    hit = cell.join(gap.filter((F.col("distance") > near) & (F.col("distance") <= far)).select(FLIGHT, "cell"), [FLIGHT, "cell"], "left_semi")
    if limit is not None:
        hit = with_rank(range_chunks(hit, FLIGHT, "cell"), FLIGHT, "cell", "_rank").filter(F.col("_rank") < limit)
    return hit.select(FLIGHT, "cell", *XYZ, F.col("p_nx").alias("nx"), F.col("p_ny").alias("ny"), F.col("p_nz").alias("nz"), "r", "g", "b", F.lit(1).alias("observation_count"), F.lit(1.5).alias("reprojection_error"),
                      F.lit(0.6).alias("model_confidence"), F.when(F.col("facade"), "facade").otherwise("roof").alias("semantic_class"), F.lit("STRUCTURAL_INFERRED").alias("provenance"),
                      F.lit("ACTIVE").alias("state"), F.lit(0.65).alias("confidence_score"), F.lit("MEDIUM").alias("confidence_level"))


def boundary_candidates(surfels: DataFrame, poses: DataFrame, voxel: float, limit: int | None = None) -> DataFrame:
    """Continuations of weak surfels by a tangent step, unless a camera closer than a metre sees empty space there.

    `poses` are the sampled views with their intrinsics; surfels carry visibility or confidence_level. With `limit`, weak
    surfels of a flight are strided to about so many.
    """
    weak = F.col("confidence_level") == "LOW"
    if "visibility" in surfels.columns:
        weak = weak | (F.col("visibility") == "UNKNOWN")
    b = surfels.filter(weak)
    if limit is not None:
        b = strided(b, "element_id", limit, FLIGHT)
    flat = F.hypot("nx", "ny")
    c = checkpointed(b.withColumns({"x": F.col("x") + F.when(flat < 1e-4, 1.0).otherwise(F.col("ny") / flat) * (voxel * 1.2), "y": F.col("y") + F.when(flat < 1e-4, 0.0).otherwise(-F.col("nx") / flat) * (voxel * 1.2)}).select(
        FLIGHT, "element_id", *XYZ, *N, "r", "g", "b", "semantic_class"))
    seen = candidate_views(c, poses, 0.1, 180.0).filter(F.col("zc") < 1.0).select(FLIGHT, "element_id").distinct()
    held = radius_join(c.withColumnRenamed("element_id", "q_id"), surfels, voxel * 2.0, "q_id").select(FLIGHT, F.col("q_id").alias("element_id")).distinct()
    bad = seen.join(held, [FLIGHT, "element_id"], "left_anti")
    return c.join(bad, [FLIGHT, "element_id"], "left_anti").withColumns({
        "provenance": F.lit("GENERATIVE_INFERRED"), "confidence_score": F.lit(0.45), "confidence_level": F.lit("LOW"), "state": F.lit("ACTIVE"),
        "reprojection_error": F.lit(2.0), "model_confidence": F.lit(0.5), "observation_count": F.lit(1)})


def ground_align(vertices: DataFrame, planes: DataFrame, vertex_id: str = "vid", min_share: float = 0.05, min_inliers: int = 100) -> DataFrame:
    """Vertices with the dominant plane level, the low tail (1st percentile) at zero and the centre at the origin.

    `planes` has nx, ny, nz, inliers, points. A steep plane is a wall and turns nothing; a weak one leaves the flight as it is.
    """
    p = planes.filter(F.col("inliers") >= F.greatest(F.lit(min_inliers), F.col("points") * min_share))
    s = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    p = p.select(FLIGHT, *[(F.col(n) * s).alias(n) for n in N])
    c, s2 = F.col("nz"), F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")
    k = (F.lit(1.0) - c) / F.when(s2 > 0, s2).otherwise(1.0)
    a, b = F.col("ny"), -F.col("nx")  # n x up
    turn = (c >= 0.5) & (s2 >= 1e-18)
    rot = [1 - b * b * k, a * b * k, b, a * b * k, 1 - a * a * k, -a, -b, a, 1 - (a * a + b * b) * k]
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    p = p.select(FLIGHT, *[F.when(turn, r).otherwise(F.lit(e)).alias(n) for r, e, n in zip(rot, eye, R.R_NAMES)])
    d = attach(vertices.select(FLIGHT, vertex_id, *XYZ), p, FLIGHT)
    known = F.col("r00").isNotNull()
    d = checkpointed(d.withColumns({f"_m{c}": F.when(known, e).otherwise(F.col(c)) for c, e in zip(XYZ, R.apply(R.r_cols(), [F.col(c) for c in XYZ]))}))
    low = exact_quantiles(d, FLIGHT, "_mz", {"_z0": 0.01})
    mid = d.groupBy(FLIGHT).agg(F.avg("_mx").alias("_cx"), F.avg("_my").alias("_cy"))
    d = attach(d, low.join(mid, FLIGHT), FLIGHT)
    shift = {"x": F.col("_cx"), "y": F.col("_cy"), "z": F.col("_z0")}
    return d.select(FLIGHT, vertex_id, *[F.when(known, F.col("_m" + c) - shift[c]).otherwise(F.col(c)).alias(c) for c in XYZ])
