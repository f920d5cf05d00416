"""Evidence on surfels: which views see them, whether pixels agree, confidence, semantics, refinement."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.functions import camera as C
from flightspark.functions import rotation as R
from flightspark.operators import celltree
from flightspark.operators.packs import by_frame, frames, known, packed
from flightspark.operators.scale import attach, exact_quantiles, once, shuffled, strided
from flightspark.session import checkpointed

FLIGHT = "flight_id"
XYZ = ("x", "y", "z")
T = ("tx", "ty", "tz")
#: Surfels above which a cell is split before views meet them.
LEAF = 256
#: Neighbouring frames that meet their surfels in one task, and the column that numbers them.
FRAMES, BLOCK = 128, "_block"


def frame_block() -> Column:
    """Number of the block of frames that a row belongs to."""
    return F.coalesce(F.floor(F.col("frame_id") / FRAMES), F.lit(-1)).cast("long")


def _decode(by: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, frame, tu, tv, w, h, rgb in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                px = np.frombuffer(rgb or b"", np.uint8)
                px = px[: min(len(px) // 3, w * h) * 3].reshape(-1, 3)
                k = np.arange(len(px))
                cols = [pa.repeat(pa.scalar(key, batch.schema.field(0).type), len(k)), pa.repeat(pa.scalar(frame, batch.schema.field(1).type), len(k)),
                        pa.array(tu * size + k % w), pa.array(tv * size + k // w), *[pa.array(px[:, c].astype(np.int32)) for c in range(3)]]
                yield pa.RecordBatch.from_arrays(cols, names=[by, "frame_id", "_pu", "_pv", "pr", "pg", "pb"])

    return run


def pixel_lookup(df: DataFrame, tiles: DataFrame, u: str, v: str, size: int, by: str = FLIGHT) -> DataFrame:
    """Adds pr, pg, pb: the pixel (u, v) of the row's frame from tiles of `size` pixels; rows outside any tile drop out.

    Every tile that some row looks into is decoded once, to one row a pixel; no row carries a tile.
    """
    want = df.select(by, "frame_id", F.floor(F.col(u) / size).cast("int").alias("tile_u"), F.floor(F.col(v) / size).cast("int").alias("tile_v")).distinct()
    used = tiles.select(by, "frame_id", F.col("tile_u").cast("int").alias("tile_u"), F.col("tile_v").cast("int").alias("tile_v"), "w", "h", "rgb")
    used = used.join(want, [by, "frame_id", "tile_u", "tile_v"], "left_semi")
    kind = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    px = used.mapInArrow(_decode(by, size), f"{by} {kind[by]}, frame_id {kind['frame_id']}, _pu long, _pv long, pr int, pg int, pb int")
    d = df.withColumns({"_pu": F.col(u).cast("long"), "_pv": F.col(v).cast("long")})
    return shuffled(d).join(px, [by, "frame_id", "_pu", "_pv"]).select(*df.columns, "pr", "pg", "pb")


def view_pairs(surfels: DataFrame, poses: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Surfel-view pairs that can see each other: views come down a tree of the surfels' cells and open only cells whose box
    reaches into their frustum.

    `poses` carries fx, fy, cx, cy, width, height. Returns the surfel columns with the pose columns, a superset of the
    pairs inside the image. Surfels without finite coordinates are left out. A block of neighbouring frames is one key of the join, to which go
    the surfels that any of its views may see. So a surfel is sent once a block and no pair is sent at all, and what needs the pairs of a frame
    together (`BLOCK` is a column of theirs) finds them in one task.
    """
    s = checkpointed(surfels)
    box = s.filter(celltree.finite()).groupBy(by).agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ])
    widest = box.agg(F.max(F.greatest(*XYZ))).first()[0] or 1.0
    tree = celltree.build(s, by, widest / 1024.0, LEAF, shallow=True)
    fx, fy, px, py = [F.col(k) for k in ("fx", "fy", "cx", "cy")]
    zero = F.lit(0.0)
    sides = [(zero, zero, F.lit(1.0)), (fx, zero, px), (-fx, zero, F.col("width") - px), (zero, fy, py), (zero, -fy, F.col("height") - py)]
    # The planes are written with the views, so that no cell works them out again.
    planes = {f"_g{i}_{c}": g for i, m in enumerate(sides) for g, c in zip(R.apply(R.r_cols(), m), XYZ)}
    views = checkpointed(poses.drop(*[c for c in poses.columns if c in surfels.columns and c != by]).withColumns(planes))
    inside = []
    for i in range(len(sides)):
        # Farthest that the box reaches to the inner side of a plane; some slack keeps rounding from cutting off a border surfel.
        ends = [[F.col(f"_g{i}_{c}") * (F.col(f"_{n}_{c}") - F.col("t" + c)) for n in ("lo", "hi")] for c in XYZ]
        reach = sum((F.greatest(*e) for e in ends[1:]), F.greatest(*ends[0]))
        size = sum((F.greatest(*[F.abs(x) for x in e]) for e in ends[1:]), F.greatest(*[F.abs(x) for x in ends[0]]))
        inside.append(reach >= size * -1e-9)

    def keep(d: DataFrame) -> DataFrame:
        for i in (0, 1, 3):
            d = once(d, _in=inside[i] & inside[i + 1] if i else inside[i]).filter("_in").drop("_in")
        return d

    cells = tree.leaves(views.join(tree.level(tree.top), by), tree.top, keep)
    cells = cells.select(by, frame_block().alias(BLOCK), "_level", *celltree.KEY).distinct()
    near = tree.points.join(cells, [by, "_level", *celltree.KEY]).drop("_level", *celltree.KEY)
    return shuffled(near).join(shuffled(views.drop(*planes).withColumn(BLOCK, frame_block())), [by, BLOCK])


def candidate_views(surfels: DataFrame, poses: DataFrame, min_z: float = 0.1, max_angle_deg: float = 65.0, by: str = FLIGHT) -> DataFrame:
    """(by, element_id, r, g, b, frame_id, u, v, zc, facing) for every view that faces the surfel and has it in its image.

    Only the columns the tests need travel with the pairs.
    """
    d = view_pairs(surfels.select(by, "element_id", *XYZ, *["n" + c for c in XYZ], "r", "g", "b"), poses, by)
    pc = C.world_to_camera([F.col(c) for c in XYZ], R.r_cols(), [F.col(t) for t in T])
    ray = [F.col(c) - F.col("t" + c) for c in XYZ]
    facing = -R.dot([F.col("n" + c) for c in XYZ], ray) / F.greatest(F.lit(1e-6), R.norm(ray))
    d = once(d, zc=pc[2], facing=facing).filter((F.col("zc") > min_z) & (F.col("facing") >= math.cos(math.radians(max_angle_deg))))
    u, v = C.project([pc[0], pc[1], F.col("zc")], *[F.col(k) for k in ("fx", "fy", "cx", "cy")])
    d = d.withColumns({"u": u, "v": v}).filter(C.in_image(F.col("u"), F.col("v"), F.col("width"), F.col("height")))
    return d.select(by, "element_id", "r", "g", "b", "frame_id", "u", "v", "zc", "facing", "width", "height", BLOCK)


def _grey(tiles: dict, size: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose pixel is in a picture, and the pixels (r, g, b) of these. A tile that is there twice gives two."""
    tu, tv = u // size, v // size
    rows, px = [], []
    for (a, b), parts in tiles.items():
        own = np.flatnonzero((tu == a) & (tv == b))
        for w, h, rgb in parts if len(own) else ():
            colours = np.frombuffer(rgb, np.uint8)
            colours = colours[: min(len(colours) // 3, w * h) * 3].reshape(-1, 3)
            x, y = u[own] - a * size, v[own] - b * size
            at = y * w + x
            there = (x < w) & (y < h) & (at < len(colours))
            rows.append(own[there])
            px.append(colours[at[there]])
    return (np.concatenate(rows), np.concatenate(px).astype(np.float64)) if rows else (np.empty(0, np.int64), np.empty((0, 3)))


def _pictures(tiles: DataFrame, by: str) -> DataFrame:
    """Tiles as rows of a pass by frame."""
    return tiles.select(by, "frame_id", F.lit(1).alias("_kind"), F.col("tile_u").cast("int").alias("tile_u"), F.col("tile_v").cast("int").alias("tile_v"),
                        F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.coalesce("rgb", F.lit(b"")).alias("rgb"))


def _tile(lists: dict, i: int) -> tuple[tuple[int, int], tuple[int, int, bytes]]:
    u, v, w, h = (lists[c][i].as_py() for c in ("tile_u", "tile_v", "w", "h"))
    return (u, v), (w, h, lists["rgb"][i].as_py())


def validate_views(candidates: DataFrame, support: DataFrame, tiles: DataFrame, tile_size: int, max_diff: float = 45.0,
                   max_error_px: float = 3.5, by: str = FLIGHT) -> DataFrame:
    """Tests of every candidate view: (by, element_id, frame_id, supporting, tested, agrees, error).

    A view that already supports the surfel counts without a test; others must show a grey level near its colour. Candidates travel packed, once, to
    their frame, where its tiles and the surfels it supports are. A number of neighbouring frames lie in one task, so that what is summed up by surfel
    afterwards is summed up there first.
    """
    key = [by, "frame_id"]
    u, v = F.rint("u"), F.rint("v")
    inner = (u >= 2) & (u < F.col("width") - 2) & (v >= 2) & (v < F.col("height") - 2)
    c = candidates.select(*key, "element_id", u.cast("int").alias("_u"), v.cast("int").alias("_v"), F.coalesce(inner, F.lit(False)).alias("_in"),
                          F.floor((F.col("r") + F.col("g") + F.col("b")) / 3).cast("double").alias("_ref"))
    c = packed(c, key, ("element_id", "_u", "_v", "_in", "_ref"), whole=False).withColumn("_kind", F.lit(2))
    held = packed(support.filter(known(key)).select(*key, "element_id"), key, ("element_id",)).withColumn("_kind", F.lit(0))
    parts = [held, _pictures(tiles, by), c]
    names = {n: t for p in parts for n, t in p.dtypes}
    rows = reduce(DataFrame.unionByName, [p.select(*[F.col(n) if n in p.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()]) for p in parts])
    kind = dict(candidates.dtypes)
    out = f"{by} {kind[by]}, element_id {kind['element_id']}, frame_id {kind['frame_id']}, supporting boolean, tested boolean, agrees boolean, error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known_by, pictures, mine = None, [], {}, []

        def tested() -> Iterator[pa.RecordBatch]:
            e = pa.concat_arrays([x["element_id"].whole(i) for x, i in mine])
            pu, pv, inside, ref = (np.concatenate([x[n].of(i) for x, i in mine]) for n in ("_u", "_v", "_in", "_ref"))
            none = np.concatenate([x["_ref"].missing(i) for x, i in mine])
            ids, n = e.to_numpy(zero_copy_only=False), np.zeros(len(e), np.int64)
            if known_by:
                own = np.sort(np.concatenate(known_by))
                n = np.searchsorted(own, ids, "right") - np.searchsorted(own, ids, "left")
            if len(n) and n.max() > 1:
                again = np.repeat(np.arange(len(n)), np.maximum(n, 1))
                e, ids, n, pu, pv, inside, ref, none = e.take(pa.array(again)), *[x[again] for x in (ids, n, pu, pv, inside, ref, none)]
            supports = n > 0
            ask = np.flatnonzero(~supports & inside)
            row, px = _grey(pictures, tile_size, pu[ask], pv[ask])
            row = ask[row]
            gap = np.abs(np.floor(0.299 * px[:, 0] + 0.587 * px[:, 1] + 0.114 * px[:, 2] + 0.5) - ref[row])
            good = gap < max_diff
            rest = np.ones(len(ids), bool)
            rest[row] = False
            rest = np.flatnonzero(rest & ~np.isin(ids, ids[row])) if len(np.unique(ids)) < len(ids) else np.flatnonzero(rest)
            for rows, cols in ((row, (np.zeros(len(row), bool), np.ones(len(row), bool), pa.array(good, mask=none[row]), np.where(good, gap / 15.0, max_error_px * 1.5))),
                               (rest, (supports[rest], np.zeros(len(rest), bool), supports[rest], pa.nulls(len(rest), pa.float64())))):
                if len(rows):
                    same = [pa.repeat(pa.scalar(k, f.type), len(rows)) for k, f in zip(at, (schema[0], schema[1]))]
                    yield pa.RecordBatch.from_arrays([same[0], e.take(pa.array(rows)), same[1], *[pa.array(x) if not isinstance(x, pa.Array) else x for x in cols]],
                                                     names=[by, "element_id", "frame_id", "supporting", "tested", "agrees", "error"])

        for batch in batches:
            schema = [batch.schema.field(by), batch.schema.field("frame_id")]
            for frame, what, lists, i in frames([batch], key):
                if frame != at:
                    if mine:
                        yield from tested()
                    at, known_by, pictures, mine = frame, [], {}, []
                if what == 0:
                    known_by.append(lists["element_id"].of(i))
                elif what == 1:
                    place, tile = _tile(lists, i)
                    pictures.setdefault(place, []).append(tile)
                else:
                    mine.append((lists, i))
        if mine:
            yield from tested()

    return by_frame(rows, key, "_kind", block=FRAMES).mapInArrow(run, out)


def update_surfel_evidence(surfels: DataFrame, tests: DataFrame, prior: DataFrame, max_error_px: float = 3.5, by: str = FLIGHT) -> DataFrame:
    """Observation count, error, visibility and provenance after the view tests.

    `prior` has one row per (surfel, sampled frame) that supported it before.
    """
    key = [by, "element_id"]
    passed = F.col("tested") & F.col("agrees")
    t = tests.groupBy(*key).agg(F.sum(F.when(passed, 1).otherwise(0)).alias("_new"), F.avg("error").alias("_err"), F.collect_set(F.when(passed, F.col("frame_id"))).alias("_seen"))
    p = prior.groupBy(*key).agg(F.count(F.lit(1)).alias("_prior"), F.collect_set("frame_id").alias("_held"))
    d = surfels.join(t, key, "left").join(p, key, "left")
    n = F.coalesce("_prior", F.lit(0)) + F.coalesce("_new", F.lit(0))
    # A view counts once, whether it supported the surfel before or has now passed its test.
    frames = F.array_sort(F.array_union(F.coalesce("_held", F.slice("_seen", 1, 0), F.array()), F.coalesce("_seen", F.array())))
    d = d.withColumns({"observation_count": n, "reprojection_error": F.coalesce("_err", F.lit(1.0)), "supporting_frames": frames}).drop("_seen", "_held")
    return d.withColumns({
        "visibility": F.when(F.col("observation_count") >= 1, "VISIBLE").otherwise("UNKNOWN"),
        "provenance": F.when((F.col("observation_count") >= 2) & (F.col("reprojection_error") < max_error_px), "MULTI_VIEW_SUPPORTED")
                       .when(F.col("observation_count") == 1, "OBSERVED").otherwise(F.col("provenance"))}).drop("_new", "_err", "_prior")


def validation_summary(updated: DataFrame, tests: DataFrame, by: str = FLIGHT) -> DataFrame:
    e = updated.groupBy(by).agg(F.avg("reprojection_error").alias("mean_reprojection_error"))
    t = tests.groupBy(by).agg(F.count(F.lit(1)).alias("total_tested"), F.sum(F.when(F.col("agrees"), 1).otherwise(0)).alias("total_passed"))
    return e.join(t, by, "left").na.fill(0, ["total_tested", "total_passed"])


def _clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def score_confidence(surfels: DataFrame) -> DataFrame:
    """Composite confidence and level; needs n_views, first and last ray (ray0_*, ray1_*, null when there is one ray)."""
    rejected = F.col("state") == "REJECTED"
    dot = _clip(R.dot([F.col("ray0_" + c) for c in XYZ], [F.col("ray1_" + c) for c in XYZ]), -1.0, 1.0)
    angle = F.when(F.col("ray1_x").isNotNull(), _clip(F.degrees(F.acos(dot)) / 15.0)).otherwise(0.5)
    raw = (0.30 * _clip((F.col("n_views") - 1) / 3.0) + 0.25 * _clip(F.lit(1.0) - F.col("reprojection_error") / 4.0) + 0.20 * angle
           + 0.15 * F.col("model_confidence") + 0.10 * F.col("gps_confidence"))
    weight = F.when(F.col("semantic_class") == "vegetation", 0.7).when(F.col("semantic_class").isin("building", "facade", "roof"), 1.15).otherwise(1.0)
    d = surfels.withColumn("confidence_score", F.when(rejected, 0.0).otherwise(_clip(raw * (F.lit(1.0) - F.col("dynamic_probability")) * weight)))
    s, n = F.col("confidence_score"), F.col("n_views")
    level = (F.when(rejected, "UNKNOWN").when((n >= 2) & (F.col("reprojection_error") < 3.0) & (s >= 0.70), "HIGH")
             .when((n >= 1) & (s >= 0.40), "MEDIUM").when(s > 0.15, "LOW").otherwise("UNKNOWN"))
    d = d.withColumn("confidence_level", level)
    lifted = (F.col("confidence_level") == "HIGH") & (F.col("provenance") == "OBSERVED")
    return d.withColumn("provenance", F.when(lifted, "MULTI_VIEW_SUPPORTED").otherwise(F.col("provenance")))


def classify_semantics(surfels: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Class, dynamic probability and state of every surfel from height, normal and colour; transient ones are rejected."""
    d = attach(surfels, exact_quantiles(surfels, by, "z", {"_ground": 0.10}), by)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    tot, top = F.greatest(F.lit(1.0), r + g + b), F.greatest(r, g, b)
    d = d.withColumns({"_dz": F.col("z") - F.col("_ground"), "_exg": (2.0 * g - r - b) / tot, "_tot": tot,
                       "_sat": (top - F.least(r, g, b)) / F.greatest(F.lit(1.0), top), "_wall": F.abs("nz") < 0.40, "_up": F.col("nz") > 0.65})
    dz, sat = F.col("_dz"), F.col("_sat")
    moving = dz.between(0.20, 2.8) & ((F.col("reprojection_error") > 2.2) | (F.col("observation_count") <= 2))
    rule = (F.when((F.col("_exg") > 0.14) & ~F.col("_wall") & (dz > -0.5), "vegetation")
            .when((b > r + 12) & (b > g + 8) & F.col("_up") & (dz <= 1.0), "water")
            .when(moving & (dz <= 2.0) & (sat > 0.15), "vehicle").when(moving & (dz <= 1.8), "person").when(moving, "unchanged")
            .when(F.col("_wall") & (dz > 1.2), "facade").when(F.col("_up") & (dz > 2.8), "roof")
            .when(F.col("_up") & dz.between(-0.8, 0.4) & (sat < 0.20) & (F.col("_tot") < 360), "road")
            .when(dz <= 0.8, "ground").when(dz > 2.0, "building").otherwise("unknown"))
    live = F.col("state") != "REJECTED"
    d = d.withColumn("_rule", F.when(live, rule).otherwise("unchanged"))
    cls = F.when(F.col("_rule") == "unchanged", F.col("semantic_class")).otherwise(F.col("_rule"))
    d = d.withColumn("semantic_class", cls)
    dyn = (F.when(F.col("_rule").isin("vegetation", "water"), 0.05).when(F.col("_rule") == "vehicle", 0.85).when(F.col("_rule") == "person", 0.80)
           .when(F.col("_rule").isin("unchanged", "unknown"), F.col("dynamic_probability")).otherwise(0.0))
    single = live & (F.col("observation_count") == 1) & F.col("semantic_class").isin("road", "ground") & (F.col("reprojection_error") > 2.5)
    gone = F.col("_rule").isin("vehicle", "person")
    return d.withColumns({"dynamic_probability": F.when(single & ~gone, 0.80).otherwise(dyn),
                          "state": F.when(gone | single, "REJECTED").otherwise(F.col("state")),
                          "counted": live & ~(single & ~gone)}).select(*surfels.columns, "counted")


def select_hr_targets(surfels: DataFrame, frames: DataFrame, limit: int | None = None, by: str = FLIGHT) -> DataFrame:
    """Confident architectural surfels (strided to `limit` per flight if given) with their sharpest supporting frame.

    `frames` has by, frame_id, sharpness; surfels carry supporting_frames.
    """
    t = surfels.filter((F.col("confidence_level") == "HIGH") & F.col("semantic_class").isin("facade", "roof", "building"))
    if limit is not None:
        t = strided(t, "element_id", limit, by)
    e = t.select(by, "element_id", F.explode("supporting_frames").alias("frame_id"))
    e = attach(e, frames.select(by, "frame_id", "sharpness"), [by, "frame_id"], "inner")
    best = e.groupBy(by, "element_id").agg(F.max_by("frame_id", F.struct("sharpness", -F.col("frame_id"))).alias("frame_id"))
    return t.join(best, [by, "element_id"])


def _edge_strength(grey: np.ndarray) -> np.ndarray:
    """Largest Sobel magnitude of each 11 x 11 grey patch (border mirrored)."""
    p = np.pad(grey.reshape(-1, 11, 11), ((0, 0), (1, 1), (1, 1)), mode="reflect")
    smooth_v = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    smooth_h = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    gx, gy = smooth_v[:, :, 2:] - smooth_v[:, :, :-2], smooth_h[:, 2:] - smooth_h[:, :-2]
    return np.sqrt(gx * gx + gy * gy).max(axis=(1, 2))


def _edges(at: DataFrame, tiles: DataFrame, tile_size: int, by: str) -> DataFrame:
    """(by, element_id, edge) for the places `at` (element_id, frame_id, _pu, _pv) whose patches lie in the picture as a whole.

    Places travel packed to the tiles of their frame; no pixel is sent.
    """
    key = [by, "frame_id"]
    c = packed(at.select(*key, "element_id", "_pu", "_pv"), key, ("element_id", "_pu", "_pv")).withColumn("_kind", F.lit(2))
    parts = [_pictures(tiles, by), c]
    names = {n: t for p in parts for n, t in p.dtypes}
    rows = reduce(DataFrame.unionByName, [p.select(*[F.col(n) if n in p.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()]) for p in parts])
    kind = dict(at.dtypes)
    k = np.arange(121)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, pictures = None, {}
        for batch in batches:
            field = batch.schema.field(by)
            for now, what, lists, i in frames([batch], key):
                if now != frame:
                    frame, pictures = now, {}
                if what == 1:
                    place, tile = _tile(lists, i)
                    pictures.setdefault(place, []).append(tile)
                    continue
                u, v = lists["_pu"].of(i), lists["_pv"].of(i)
                for start in range(0, len(u), 1024):
                    pu, pv = (x[start:start + 1024, None] for x in (u, v))
                    row, px = _grey(pictures, tile_size, (pu + k % 11 - 5).reshape(-1), (pv + k // 11 - 5).reshape(-1))
                    grey = np.zeros(len(pu) * 121)
                    grey[row] = np.floor(0.299 * px[:, 0] + 0.587 * px[:, 1] + 0.114 * px[:, 2] + 0.5)
                    whole = np.flatnonzero((np.bincount(row, minlength=len(grey)).reshape(-1, 121) == 1).all(axis=1))
                    if len(whole):
                        edge = _edge_strength(grey.reshape(-1, 121)[whole])
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(frame[0], field.type), len(whole)), lists["element_id"].whole(i).take(pa.array(start + whole)), pa.array(edge)],
                                                         names=[by, "element_id", "edge"])

    return by_frame(rows, key, "_kind").mapInArrow(run, f"{by} {kind[by]}, element_id {kind['element_id']}, edge double")


def hr_refine(targets: DataFrame, poses: DataFrame, tiles: DataFrame, tile_size: int, threshold: float = 30.0, by: str = FLIGHT) -> DataFrame:
    """Targets with raised confidence where the picture around them holds a strong edge (adds refined).

    A patch of 11 x 11 pixels is cut from at most four tiles where these lie.
    """
    d = attach(targets, poses.select(by, "frame_id", *R.R_NAMES, *T, "fx", "fy", "cx", "cy", "width", "height"), [by, "frame_id"], "inner")
    pc = C.world_to_camera([F.col(c) for c in XYZ], R.r_cols(), [F.col(t) for t in T])
    d = d.withColumns(dict(zip(("_xc", "_yc", "_zc"), pc)))
    u, v = C.project([F.col("_xc"), F.col("_yc"), F.col("_zc")], *[F.col(k) for k in ("fx", "fy", "cx", "cy")])
    d = d.withColumns({"_fu": u, "_fv": v}).filter(C.in_image(F.col("_fu"), F.col("_fv"), F.col("width"), F.col("height")))
    d = d.withColumns({"_pu": F.rint("_fu").cast("long"), "_pv": F.rint("_fv").cast("long")})
    d = d.filter((F.col("_pu") >= 6) & (F.col("_pu") < F.col("width") - 6) & (F.col("_pv") >= 6) & (F.col("_pv") < F.col("height") - 6))
    sharp = _edges(d, tiles, tile_size, by).filter(F.col("edge") > threshold).select(by, "element_id").distinct()
    out = targets.join(sharp.withColumn("refined", F.lit(True)), [by, "element_id"], "left")
    hit = F.coalesce("refined", F.lit(False))
    return out.withColumns({"model_confidence": F.when(hit, F.least(F.lit(1.0), F.col("model_confidence") * 1.1)).otherwise(F.col("model_confidence")),
                            "confidence_score": F.when(hit, F.least(F.lit(1.0), F.col("confidence_score") + 0.05)).otherwise(F.col("confidence_score")),
                            "refined": hit})


def visibility_classes(surfels: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Zero-filled counts per visibility state; a surfel with any supporting frame is visible."""
    seen = F.size("supporting_frames") >= 1
    d = surfels.groupBy(by).agg(F.sum(F.when(seen, 1).otherwise(0)).alias("VISIBLE"), F.lit(0).alias("OCCLUDED"),
                                F.sum(F.when(seen, 0).otherwise(1)).alias("UNKNOWN"))
    return d.select(by, F.explode(F.array(*[F.struct(F.lit(s).alias("visibility"), F.col(s).cast("long").alias("n")) for s in ("VISIBLE", "OCCLUDED", "UNKNOWN")])).alias("_x")).select(by, "_x.*")
