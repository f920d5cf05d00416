"""Mesh tables: face metrics, topology, shells, small repairs, provenance.

`mesh_vertices(flight_id, vid, x, y, z, ...)` and `mesh_faces(flight_id, fid, v0, v1, v2, inferred)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightspark.functions import rotation as R
from flightspark.operators.grid import nearest_neighbor
from flightspark.operators.scale import attach, connected_components, dealt, exact_quantiles, range_chunks, shuffled, with_rank, with_running_sum
from flightspark.session import checkpointed

FLIGHT = "flight_id"
XYZ = ("x", "y", "z")


def face_metrics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with area, unit normal (nx, ny, nz), centroid (mx, my, mz) and longest edge. `faces` is counted first, so it is best a written table."""
    d, rows = faces, faces.count()
    for k in range(3):
        corner = vertices.select(FLIGHT, F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in XYZ])
        on = [FLIGHT, f"v{k}"]
        d = shuffled(dealt(d, rows, *on)).join(dealt(corner, rows, *on), on)
    p = [[F.col(f"{c}{k}") for c in XYZ] for k in range(3)]
    sub = lambda a, b: [x - y for x, y in zip(a, b)]
    d = d.withColumns(dict(zip(("_nx", "_ny", "_nz"), R.cross(sub(p[1], p[0]), sub(p[2], p[0])))))
    d = d.withColumn("_len", R.norm([F.col("_n" + c) for c in XYZ]))
    safe = F.when(F.col("_len") > 0, F.col("_len"))
    return d.select(*faces.columns, (F.col("_len") / 2).alias("area"), *[(F.col("_n" + c) / safe).alias("n" + c) for c in XYZ],
                    *[((p[0][i] + p[1][i] + p[2][i]) / 3).alias("m" + c) for i, c in enumerate(XYZ)],
                    F.greatest(R.norm(sub(p[1], p[0])), R.norm(sub(p[2], p[1])), R.norm(sub(p[0], p[2]))).alias("longest"))


def drop_degenerate(metrics: DataFrame, voxel: float, min_area: float = 1e-10, min_left: int = 32) -> DataFrame:
    """Faces with real area; overlong ones go too when enough faces remain in their flight."""
    d = metrics.filter(F.col("area") > min_area)
    fit = F.col("longest") <= voxel * 6.0
    left = d.groupBy(FLIGHT).agg(F.sum(F.when(fit, 1).otherwise(0)).alias("_left"))
    return attach(d, left, FLIGHT).filter(fit | (F.col("_left") < min_left)).drop("_left")


def mesh_edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (a < b) with the number of faces on each and the smallest such face."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    e = faces.select(FLIGHT, "fid", F.explode(pairs).alias("_e")).select(FLIGHT, "fid", "_e.a", "_e.b")
    return e.groupBy(FLIGHT, "a", "b").agg(F.count(F.lit(1)).alias("uses"), F.min("fid").alias("fid"))


def edge_topology(faces: DataFrame) -> DataFrame:
    """Edges, boundary edges (one face) and non-manifold edges (more than two) per flight."""
    u = F.col("uses")
    return mesh_edges(faces).groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("edges"), F.sum(F.when(u == 1, 1).otherwise(0)).alias("boundary"),
                                                 F.sum(F.when(u > 2, 1).otherwise(0)).alias("non_manifold"))


def face_shells(faces: DataFrame) -> DataFrame:
    """(flight_id, fid, shell): faces joined across shared edges; every edge links its faces to one of them."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    e = faces.select(FLIGHT, "fid", F.explode(pairs).alias("_e")).select(FLIGHT, "fid", "_e.a", "_e.b")
    head = F.min("fid").over(Window.partitionBy(FLIGHT, "a", "b"))
    links = e.filter(F.col(FLIGHT).isNotNull() & F.col("a").isNotNull()).select(FLIGHT, "fid", head.alias("head"))
    return connected_components(links, [FLIGHT], "fid", "head").select(FLIGHT, F.col("node").alias("fid"), F.col("component").alias("shell"))


def mesh_components(metrics: DataFrame, shells: DataFrame) -> DataFrame:
    """Faces, area and extent (of the face centroids) of every shell."""
    d = metrics.join(shells, [FLIGHT, "fid"])
    return d.groupBy(FLIGHT, "shell").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"),
                                          *[f("m" + c).alias(f"{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])


def drop_fragments(metrics: DataFrame, shells: DataFrame, voxel: float | None = None) -> DataFrame:
    """Faces of shells that are large enough: by area when a voxel size is given, else by face count."""
    comp = checkpointed(mesh_components(metrics, shells))
    best = comp.groupBy(FLIGHT).agg(F.max("area").alias("_area"), F.max("faces").alias("_faces"))
    c = attach(comp, best, FLIGHT)
    if voxel is not None:
        floor = max((voxel * 6.0) ** 2, 0.25)
        keep = F.col("area") >= F.least(F.lit(floor), F.col("_area"))
    else:
        keep = F.col("faces") >= F.greatest(F.lit(40), F.floor(F.col("_faces") * 0.005))
        keep = keep | (F.col("_faces") < 40)
    return metrics.join(shells, [FLIGHT, "fid"]).join(c.filter(keep).select(FLIGHT, "shell"), [FLIGHT, "shell"], "left_semi")


def drop_islands(metrics: DataFrame, shells: DataFrame, coarsest: float, anchor_faces: int = 800, anchor_area: float = 2.5,
                 crumb_faces: int = 300, crumb_area: float = 0.5, far_faces: int = 3000) -> DataFrame:
    """Shells with their verdict (anchor, far, crumb, near, stray): stray geometry away from the built core is told apart.

    The core is the extent of the largest shells that hold 70 % of the faces.
    """
    comp = checkpointed(mesh_components(metrics, shells).withColumn("_neg", -F.col("faces")))
    order = ["_neg", "shell"]
    run = with_rank(range_chunks(comp, FLIGHT, order), FLIGHT, order, "_rank")
    run = checkpointed(with_running_sum(run, FLIGHT, order, "faces", "_before").drop("_chunk"))
    total = run.groupBy(FLIGHT).agg(F.sum("faces").alias("_total"))
    major = attach(run, total, FLIGHT).filter((F.col("_rank") < 2) | (F.col("_before") < 0.70 * F.col("_total")))
    core = major.groupBy(FLIGHT).agg(*[f(f"{c}_{n}").alias(f"core_{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])
    d = attach(run, core, FLIGHT)
    mid = {c: (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2 for c in XYZ}
    off = F.hypot(mid["x"] - (F.col("core_x_min") + F.col("core_x_max")) / 2, mid["y"] - (F.col("core_y_min") + F.col("core_y_max")) / 2)
    diag = R.norm([F.col(f"core_{c}_max") - F.col(f"core_{c}_min") for c in XYZ])
    gone = ((mid["z"] < F.col("core_z_min") - 8.0) | (mid["z"] > F.col("core_z_max") + 15.0)
            | ((off > F.greatest(F.lit(35.0), diag * 1.2)) & (F.col("faces") < far_faces)))
    kind = (F.when(gone, "far").when((F.col("faces") < crumb_faces) & (F.col("area") < crumb_area), "crumb")
            .when((F.col("faces") >= anchor_faces) | (F.col("area") >= anchor_area), "anchor").otherwise("open"))
    d = d.withColumn("kind", kind)
    none = d.groupBy(FLIGHT).agg(F.max(F.when(F.col("kind") == "anchor", 1).otherwise(0)).alias("_any"))
    d = checkpointed(attach(d, none, FLIGHT).withColumn("kind", F.when((F.col("_any") == 0) & (F.col("_rank") == 0), "anchor").otherwise(F.col("kind"))))
    f = checkpointed(metrics.join(shells, [FLIGHT, "fid"]).join(d.select(FLIGHT, "shell", "kind"), [FLIGHT, "shell"]).select(
        FLIGHT, "shell", "fid", "kind", *[F.col("m" + c).alias(c) for c in XYZ]))
    near = nearest_neighbor(f.filter(F.col("kind") == "open"), f.filter(F.col("kind") == "anchor").withColumnRenamed("fid", "anchor"), "fid", "anchor", max(1.0, coarsest))
    gap = exact_quantiles(near.join(f.select(FLIGHT, "fid", "shell"), [FLIGHT, "fid"]), [FLIGHT, "shell"], "distance", {"gap": 0.05})
    limit = max(18.0, 25.0 * coarsest)
    return d.join(gap, [FLIGHT, "shell"], "left").select(
        FLIGHT, "shell", "faces", "area", F.when(F.col("kind") != "open", F.col("kind")).when(F.col("gap") <= limit, "near").otherwise("stray").alias("verdict"), "gap")


def boundary_loops(faces: DataFrame, vertices: DataFrame, voxel: float, max_vertices: int = 24) -> DataFrame:
    """Small closed boundary loops: (flight_id, loop, vertices, diagonal, cx, cy, cz), loop being its smallest vertex.

    A loop is a ring of boundary edges in which every vertex has exactly two of them; it can be closed by a fan of one
    triangle per edge about the centroid (one triangle for three edges).
    """
    edge = checkpointed(mesh_edges(faces).filter(F.col("uses") == 1).select(FLIGHT, "a", "b"))
    ends = edge.select(FLIGHT, F.col("a").alias("vid")).unionByName(edge.select(FLIGHT, F.col("b").alias("vid")))
    pinch = ends.groupBy(FLIGHT, "vid").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") != 2).select(FLIGHT, "vid")
    comp = checkpointed(connected_components(edge, [FLIGHT], "a", "b"))
    bad = comp.join(pinch.withColumnRenamed("vid", "node"), [FLIGHT, "node"], "left_semi").select(FLIGHT, "component").distinct()
    ring = comp.join(bad, [FLIGHT, "component"], "left_anti").join(vertices.select(FLIGHT, F.col("vid").alias("node"), *XYZ), [FLIGHT, "node"])
    g = ring.groupBy(FLIGHT, F.col("component").alias("loop")).agg(
        F.count(F.lit(1)).alias("vertices"), *[F.avg(c).alias("c" + c) for c in XYZ], R.norm([F.max(c) - F.min(c) for c in XYZ]).alias("diagonal"))
    return g.filter(F.col("vertices").between(3, max_vertices) & (F.col("diagonal") <= max(6.0 * voxel, 0.12)))


def close_loops(loops: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles that close the loops of `boundary_loops`: (flight_id, loop, v0, v1, v2), wound like the faces around.

    Every boundary edge of a loop gets a triangle with the loop's centroid, which is the new vertex -1 - loop; a loop of three
    edges is closed by one triangle of its own vertices.
    """
    sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    e = faces.select(FLIGHT, F.explode(sides).alias("_e")).select(FLIGHT, "_e.p", "_e.q")
    e = e.groupBy(FLIGHT, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(
        F.count(F.lit(1)).alias("uses"), F.min("p").alias("p"), F.min("q").alias("q"))  # of one side, where it matters; numbers can be hashed, structs are sorted
    rim = checkpointed(e.filter("uses = 1").select(FLIGHT, "p", "q"))
    ring = connected_components(rim, [FLIGHT], "p", "q").select(FLIGHT, F.col("node").alias("p"), F.col("component").alias("loop"))
    own = rim.join(ring.join(loops.select(FLIGHT, "loop", "vertices"), [FLIGHT, "loop"]), [FLIGHT, "p"])
    fan = own.filter("vertices > 3").select(FLIGHT, "loop", F.col("q").alias("v0"), F.col("p").alias("v1"), (F.lit(-1) - F.col("loop")).alias("v2"))
    three = own.filter("vertices = 3 AND p = loop").select(FLIGHT, "loop", F.col("q").alias("v0"), F.col("p").alias("v1"))
    before = own.filter("vertices = 3 AND q = loop").select(FLIGHT, "loop", F.col("p").alias("v2"))
    return fan.unionByName(three.join(before, [FLIGHT, "loop"]))


def mesh_provenance(metrics: DataFrame) -> DataFrame:
    """Measured and inferred faces and areas of each delivered mesh."""
    inf = F.coalesce("inferred", F.lit(False))
    d = metrics.groupBy(FLIGHT).agg(F.sum(F.when(inf, 0).otherwise(1)).alias("measured_faces"), F.sum(F.when(inf, 1).otherwise(0)).alias("inferred_faces"),
                                    F.sum(F.when(inf, 0.0).otherwise(F.col("area"))).alias("measured_area_m2"), F.sum(F.when(inf, F.col("area")).otherwise(0.0)).alias("inferred_area_m2"))
    n, a = F.col("measured_faces") + F.col("inferred_faces"), F.col("measured_area_m2") + F.col("inferred_area_m2")
    return d.withColumns({"inferred_face_percent": F.when(n > 0, 100.0 * F.col("inferred_faces") / n).otherwise(0.0),
                          "inferred_area_percent": F.when(a > 0, 100.0 * F.col("inferred_area_m2") / a).otherwise(0.0)})


def outlier_filter(vertices: DataFrame, box: dict[str, tuple[float, float]] | None = None, blue_margin: float = 20.0, min_blue: float = 120.0) -> DataFrame:
    """Vertices that are not sky-blue and lie inside the crop box."""
    sky = (F.col("b") > F.col("r") + blue_margin) & (F.col("b") > F.col("g") + blue_margin / 2) & (F.col("b") > min_blue)
    keep = ~sky
    for c, (lo, hi) in (box or {}).items():
        keep = keep & F.col(c).between(lo, hi)
    return vertices.filter(keep)
