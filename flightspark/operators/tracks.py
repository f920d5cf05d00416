"""Feature tracks: filtering, matching, grouping, triangulation, error-based pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightspark.functions import camera as C
from flightspark.functions import rotation as R
from flightspark.operators.scale import attach, connected_components, exact_quantiles, range_chunks, shuffled, with_rank
from flightspark.session import checkpointed

FLIGHT = "flight_id"
TRACK = [FLIGHT, "track_id"]
T = ["tx", "ty", "tz"]
K = ["fx", "fy", "cx", "cy"]


def filter_tracks(obs: DataFrame, min_obs: int = 3, frames: DataFrame | None = None) -> DataFrame:
    """Observations of tracks seen often enough, counting only the given frames when there are any."""
    if frames is not None:
        obs = shuffled(obs).join(frames.select(FLIGHT, "frame_id"), [FLIGHT, "frame_id"], "left_semi")
    keep = obs.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_obs).select(*TRACK)
    return shuffled(obs).join(keep, TRACK, "left_semi")


def pair_matches(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared tracks of frame pairs (flight_id, frame_id, frame_id_2) with both pixel positions."""
    a = attach(obs.select(*TRACK, "frame_id", "u", "v"), pairs.select(FLIGHT, "frame_id", "frame_id_2"), [FLIGHT, "frame_id"], "inner")
    b = obs.select(*TRACK, F.col("frame_id").alias("frame_id_2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    return a.join(b, [*TRACK, "frame_id_2"]).select(FLIGHT, "frame_id", "frame_id_2", "track_id", "u", "v", "u2", "v2")


def track_stats(obs: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """Number of tracks and observations, shortest, median and longest track, mean span, inlier count per flight."""
    t = checkpointed(obs.groupBy(*TRACK).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.max("frame_id") - F.min("frame_id")).cast("double").alias("span")))
    d = t.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("observations"), F.min("n").alias("min_length"),
                              F.max("n").alias("max_length"), F.avg("n").alias("mean_length"))
    d = d.join(exact_quantiles(t, FLIGHT, "n", {"median_length": 0.5}), FLIGHT).join(exact_quantiles(t, FLIGHT, "span", {"median_span": 0.5}), FLIGHT)
    if landmarks is not None:
        inl = landmarks.groupBy(FLIGHT).agg(F.sum(F.when(F.col("is_inlier"), 1).otherwise(0)).alias("inliers"))
        d = d.join(inl, FLIGHT, "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)))
    return d


def anchor_drift(moves: DataFrame, max_back: float = 1.5, max_anchor_back: float = 1.0, max_gap: float = 2.0) -> DataFrame:
    """Chained positions checked against their anchor: adds kept, u, v and drift_dropped.

    Columns: pu, pv previous; bu, bv back-projected; cu, cv chained; qu, qv anchor; ru, rv anchor back-projected; au, av re-found.
    """
    def gap(a: str, b: str) -> Column:
        return F.sqrt(F.pow(F.col(a + "u") - F.col(b + "u"), 2) + F.pow(F.col(a + "v") - F.col(b + "v"), 2))

    keep = gap("p", "b") < max_back
    trust = (gap("q", "r") < max_anchor_back) & (gap("a", "c") <= max_gap)
    return moves.withColumns({"kept": keep & trust, "drift_dropped": keep & ~trust,
                              "u": F.when(trust, F.col("au")).otherwise(F.col("cu")), "v": F.when(trust, F.col("av")).otherwise(F.col("cv"))})


def match_descriptors(features: DataFrame, pairs: DataFrame, metric: str = "hamming", ratio: float = 0.75, min_matches: int = 30,
                      by: str = FLIGHT) -> DataFrame:
    """Ratio-tested nearest features of frame pairs (by, frame_id, frame_id_2, kp, kp_2, distance).

    `features` has by, frame_id, kp and `desc`: an array of 64-bit words (hamming) or of numbers (l2). Only listed pairs
    of frames meet, and no more than the two best candidates of a feature leave a task.
    """
    a = features.select(by, "frame_id", "kp", "desc").join(pairs.select(by, "frame_id", "frame_id_2"), [by, "frame_id"])
    b = features.select(by, F.col("frame_id").alias("frame_id_2"), F.col("kp").alias("kp_2"), F.col("desc").alias("desc_2"))
    if metric == "hamming":
        parts = F.zip_with("desc", "desc_2", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("double"))
        dist = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)
    else:
        parts = F.zip_with("desc", "desc_2", lambda p, q: (p - q).cast("double") * (p - q).cast("double"))
        dist = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p))
    j = a.join(b, [by, "frame_id_2"]).select(by, "frame_id", "frame_id_2", "kp", "kp_2", dist.alias("distance"))
    w = Window.partitionBy(by, "frame_id", "frame_id_2", "kp").orderBy("distance", "kp_2")
    two = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    best = two.groupBy(by, "frame_id", "frame_id_2", "kp").agg(
        F.max(F.when(F.col("_r") == 1, F.col("kp_2"))).alias("kp_2"), F.max(F.when(F.col("_r") == 1, F.col("distance"))).alias("distance"),
        F.max(F.when(F.col("_r") == 2, F.col("distance"))).alias("_second"))
    good = checkpointed(best.filter(F.col("distance") < F.col("_second") * ratio).drop("_second"))
    enough = good.groupBy(by, "frame_id", "frame_id_2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_matches)
    return good.join(enough.select(by, "frame_id", "frame_id_2"), [by, "frame_id", "frame_id_2"], "left_semi")


def epipolar_inliers(matches: DataFrame, poses: DataFrame, threshold_px: float = 2.0, by: str = FLIGHT) -> DataFrame:
    """Inliers of each frame pair under the epipolar geometry of its two known poses (Sampson distance in pixels)."""
    p = poses.select(by, "frame_id", *R.R_NAMES, *T, *K)
    q = p.select(by, *[F.col(c).alias(c + "_2") for c in p.columns if c != by])
    d = attach(attach(matches, p, [by, "frame_id"], "inner"), q, [by, "frame_id_2"], "inner")
    r1, r2 = R.r_cols(), [F.col(f"{n}_2") for n in R.R_NAMES]
    d = d.withColumns({f"_r{i}": c for i, c in enumerate(R.matmul(R.transpose(r2), r1))})
    shift = R.apply(R.transpose(r2), [F.col(t) - F.col(t + "_2") for t in T])
    d = d.withColumns({f"_t{i}": c for i, c in enumerate(shift)})
    t, rel = [F.col(f"_t{i}") for i in range(3)], [F.col(f"_r{i}") for i in range(9)]
    zero = F.lit(0.0)
    skew = [zero, -t[2], t[1], t[2], zero, -t[0], -t[1], t[0], zero]
    d = d.withColumns({f"_e{i}": c for i, c in enumerate(R.matmul(skew, rel))})
    e = [F.col(f"_e{i}") for i in range(9)]
    d = d.withColumns({"_x1": (F.col("u") - F.col("cx")) / F.col("fx"), "_y1": (F.col("v") - F.col("cy")) / F.col("fy"),
                       "_x2": (F.col("u2") - F.col("cx_2")) / F.col("fx_2"), "_y2": (F.col("v2") - F.col("cy_2")) / F.col("fy_2")})
    one = F.lit(1.0)
    a, b = [F.col("_x1"), F.col("_y1"), one], [F.col("_x2"), F.col("_y2"), one]
    d = d.withColumns({f"_l{i}": c for i, c in enumerate(R.apply(e, a))})
    d = d.withColumns({f"_m{i}": c for i, c in enumerate(R.apply(R.transpose(e), b))})
    num = F.pow(R.dot(b, [F.col(f"_l{i}") for i in range(3)]), 2)
    den = F.col("_l0") * F.col("_l0") + F.col("_l1") * F.col("_l1") + F.col("_m0") * F.col("_m0") + F.col("_m1") * F.col("_m1")
    d = d.withColumn("sampson_px2", num / F.greatest(F.lit(1e-18), den) * F.col("fx") * F.col("fy"))
    g = d.groupBy(by, "frame_id", "frame_id_2").agg(F.count(F.lit(1)).alias("matches"),
                                                    F.sum(F.when(F.col("sampson_px2") <= threshold_px**2, 1).otherwise(0)).alias("inliers"))
    return g.withColumns({"inlier_ratio": F.col("inliers") / F.col("matches"), "weight": F.col("inliers") / 10.0})


def merge_tracks(edges: DataFrame, features: DataFrame, min_frames: int = 3, by: str = FLIGHT) -> tuple[DataFrame, DataFrame]:
    """Tracks from matched features: (members of good groups, counts of groups kept, short and contradictory).

    `edges` has by, a, b (feature ids); `features` has by, node, frame_id. A group with two features in one frame is dropped.
    """
    comp = checkpointed(connected_components(edges, [by], "a", "b"))
    d = comp.join(features.select(by, "node", "frame_id"), [by, "node"])
    g = d.groupBy(by, "component", "frame_id").agg(F.count(F.lit(1)).alias("_k")).groupBy(by, "component").agg(
        F.sum("_k").alias("n"), F.count(F.lit(1)).alias("frames"))
    g = checkpointed(g.withColumn("kind", F.when(F.col("n") < min_frames, "short").when(F.col("frames") < F.col("n"), "contradictory").otherwise("kept")))
    members = d.join(g.filter(F.col("kind") == "kept").select(by, "component"), [by, "component"], "left_semi")
    return members, g.groupBy(by, "kind").agg(F.count(F.lit(1)).alias("groups"))


# Directions whose extremes bound the widest pair from below.
_DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]


#: Halvings of a key's extent at most; points that share a cell of the last one are compared with each other.
_LEVELS = 20


def farthest_pairs(points: DataFrame, by: list[str], at: tuple[str, ...], name: str) -> DataFrame:
    """The two places of each key that lie farthest apart (by, name, name_2, distance), the smallest names of equal pairs.

    Exact, without meeting all places: cells of a key are paired, and a pair goes on only if the farthest corners of what it holds
    are at least as far apart as two places known so far. Cells are halved until few places are left to compare, so places on a
    circle meet those about opposite to them. A large key is spread over its cells. Names at one place count once.
    """
    d = checkpointed(points.groupBy(*by, *at).agg(F.min(name).alias(name)))
    ends = []
    for i, way in enumerate(_DIRECTIONS):
        along = sum((F.col(t) * w for t, w in zip(at, way)), F.lit(0.0))
        ends += [F.min_by(F.struct(*at), along).alias(f"_lo{i}"), F.max_by(F.struct(*at), along).alias(f"_hi{i}")]
    s = d.groupBy(*by).agg(*ends, *[F.min(t).alias("_o" + t) for t in at], F.greatest(*[F.max(t) - F.min(t) for t in at]).alias("_size"))
    known = F.greatest(*[R.norm([F.col(f"_lo{i}.{t}") - F.col(f"_hi{i}.{t}") for t in at]) for i in range(len(_DIRECTIONS))])
    s = checkpointed(s.filter("_size > 0").select(*by, known.alias("_known"), "_size", *["_o" + t for t in at]))
    d = d.join(s, by).select(*by, name, *at, *[((F.col(t) - F.col("_o" + t)) / F.col("_size")).alias("_u" + t) for t in at])
    d, places = checkpointed(d), 0

    def cell(level: int) -> Column:
        """Number of the cell of a place: 21 bits an axis."""
        parts = [F.floor(F.col("_u" + t) * float(1 << level)).cast("long") for t in at]
        return sum((F.shiftleft(c, 21 * k) for k, c in enumerate(parts[1:], 1)), parts[0])

    def boxes(level: int, side: str) -> DataFrame:
        g = d.groupBy(*by, cell(level - 1).alias(f"_{side}"), cell(level).alias(f"_{side}k")).agg(
            F.count(F.lit(1)).alias(f"_n{side}"), F.min(F.struct(*at)).alias(f"_r{side}"), *[f(t).alias(f"_{n}{side}{t}") for t in at for n, f in (("l", F.min), ("h", F.max))])
        return g

    pairs = None
    for level in range(1, _LEVELS + 1):
        a, b = boxes(level, "a"), boxes(level, "b")
        if pairs is None:
            both = a.drop("_a").join(b.drop("_b"), by).filter("_ak <= _bk").join(s.select(*by, "_known"), by)
        else:
            both = pairs.join(a, [*by, "_a"]).join(b, [*by, "_b"]).filter("_a <> _b OR _ak <= _bk")
        apart = R.norm([F.greatest(F.col(f"_hb{t}") - F.col(f"_la{t}"), F.col(f"_ha{t}") - F.col(f"_lb{t}")) for t in at])
        met = R.norm([F.col(f"_ra.{t}") - F.col(f"_rb.{t}") for t in at])
        both = checkpointed(both.select(*by, F.col("_ak").alias("_a"), F.col("_bk").alias("_b"), (F.col("_na") * F.col("_nb")).alias("_work"), "_known", apart.alias("_apart"), met.alias("_met")).filter("_apart >= _known - 2e-9"))
        best = both.groupBy(*by).agg(F.max(F.greatest("_known", "_met")).alias("_known"))
        pairs = checkpointed(attach(both.drop("_known"), best, by, "inner").filter("_apart >= _known - 2e-9").select(*by, "_a", "_b", "_work", "_known"))
        work = pairs.agg(F.sum("_work")).first()[0] or 0
        places = places or d.count()
        if work <= 8 * places:
            break
    pairs = pairs.select(*by, "_a", "_b", "_known")
    place = d.select(*by, cell(level).alias("_a"), name, *at)
    other = d.select(*by, cell(level).alias("_b"), F.col(name).alias("_name"), *[F.col(t).alias("_2" + t) for t in at])
    far = R.norm([F.col(t) - F.col("_2" + t) for t in at])
    met = pairs.join(place, [*by, "_a"]).join(other, [*by, "_b"]).filter(F.col(name) != F.col("_name")).withColumn("distance", far).filter("distance >= _known - 2e-9")
    met = met.select(*by, F.least(name, "_name").alias(name), F.greatest(name, "_name").alias(f"{name}_2"), "distance")
    top = met.groupBy(*by).agg(F.max_by(F.struct(name, f"{name}_2", "distance"), F.struct(F.round("distance", 9), -F.col(name), -F.col(f"{name}_2"))).alias("_b"))
    return top.select(*by, "_b.*")


def widest_pair(obs: DataFrame, poses: DataFrame, min_baseline: float = 0.2, by: str = FLIGHT) -> DataFrame:
    """The two views of each track that lie farthest apart (by, track_id, frame_id, frame_id_2, baseline)."""
    d = attach(obs.select(*TRACK, "frame_id"), poses.select(by, "frame_id", *T), [by, "frame_id"], "inner")
    best = farthest_pairs(d, list(TRACK), T, "frame_id").withColumnRenamed("distance", "baseline")
    return best.filter(F.col("baseline") >= min_baseline)


_SUMS = [(i, j) for i in range(4) for j in range(i, 4)]


def _smallest_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Null direction of the summed 4 x 4 normal matrices, as homogeneous points."""
    for pdf in batches:
        m = np.zeros((len(pdf), 4, 4))
        for i, j in _SUMS:
            m[:, i, j] = m[:, j, i] = pdf[f"m{i}{j}"].to_numpy()
        vec = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.zeros((0, 4))
        out = pdf[["flight_id", "track_id"]].copy()
        for k, c in enumerate(("hx", "hy", "hz", "hw")):
            out[c] = vec[:, k]
        yield out


def _linear_points(rows: DataFrame, normalise: bool) -> DataFrame:
    """Least-squares points (hx, hy, hz, hw) of tracks; a row holds one observation with its pose and intrinsics.

    Each observation adds two equations; their 4 x 4 normal matrix is summed per track, so long tracks stay cheap.
    """
    r = R.r_cols()
    t_cw = [-c for c in R.apply(R.transpose(r), [F.col(t) for t in T])]
    cam = [[r[0], r[3], r[6], t_cw[0]], [r[1], r[4], r[7], t_cw[1]], [r[2], r[5], r[8], t_cw[2]]]
    d = rows.withColumns({f"_p{i}{j}": c for i, row in enumerate(cam) for j, c in enumerate(row)})
    p = [[F.col(f"_p{i}{j}") for j in range(4)] for i in range(3)]
    eq = {}
    for name, axis, pix, f, c in (("a", 0, "u", "fx", "cx"), ("b", 1, "v", "fy", "cy")):
        for j in range(4):
            eq[f"_{name}{j}"] = (F.col(pix) - F.col(c)) * p[2][j] - F.col(f) * p[axis][j]
    d = d.withColumns(eq)
    for name in "ab":
        n = F.sqrt(sum((F.col(f"_{name}{j}") * F.col(f"_{name}{j}") for j in range(1, 4)), F.col(f"_{name}0") * F.col(f"_{name}0")))
        d = d.withColumn(f"_n{name}", F.greatest(F.lit(1e-12), n) if normalise else F.lit(1.0))
    d = d.withColumns({f"_{n}{j}": F.col(f"_{n}{j}") / F.col(f"_n{n}") for n in "ab" for j in range(4)})
    m = d.groupBy(*TRACK).agg(*[F.sum(F.col(f"_a{i}") * F.col(f"_a{j}") + F.col(f"_b{i}") * F.col(f"_b{j}")).alias(f"m{i}{j}") for i, j in _SUMS])
    return m.mapInPandas(_smallest_vectors, "flight_id long, track_id long, hx double, hy double, hz double, hw double")


def _posed(obs: DataFrame, poses: DataFrame) -> DataFrame:
    """Observations with their poses. Poses pack so well into a file that Spark would send them whole to all tasks."""
    return shuffled(obs.select(*TRACK, "frame_id", "u", "v")).join(poses.select(FLIGHT, "frame_id", *R.R_NAMES, *T, *K), [FLIGHT, "frame_id"])


def _errors(posed: DataFrame, points: DataFrame) -> DataFrame:
    """Adds zc and the pixel error of every observation of tracks with a point (x, y, z)."""
    d = shuffled(posed).join(points.select(*TRACK, "x", "y", "z"), TRACK)
    pc = C.world_to_camera([F.col(c) for c in "xyz"], R.r_cols(), [F.col(t) for t in T])
    d = d.withColumns(dict(zip(("xc", "yc", "zc"), pc)))
    du, dv = F.col("fx") * F.col("xc") / F.col("zc") + F.col("cx") - F.col("u"), F.col("fy") * F.col("yc") / F.col("zc") + F.col("cy") - F.col("v")
    return d.withColumn("error", F.sqrt(du * du + dv * dv))


def triangulate(obs: DataFrame, poses: DataFrame, max_reproj_px: float = 2.0, min_angle_deg: float = 1.0) -> DataFrame:
    """Multi-view points of tracks seen from two or more posed frames (flight_id, track_id, x, y, z, mean_error).

    Dropped: points at infinity, behind a camera, with a large error, or whose rays are all nearly parallel. The ray test
    compares each ray with the two extreme ones instead of all with all; see `_angle_reached`.
    """
    posed = checkpointed(_posed(filter_tracks(obs, 2, poses), poses))
    h = _linear_points(posed, True).filter(F.abs("hw") > 1e-9)
    pts = checkpointed(h.select(*TRACK, *[(F.col("h" + c) / F.col("hw")).alias(c) for c in "xyz"]))
    e = checkpointed(_errors(posed, pts))
    good = e.groupBy(*TRACK).agg(F.min("zc").alias("_z"), F.avg("error").alias("mean_error")).filter(
        (F.col("_z") > 0.05) & (F.col("mean_error") <= 2.0 * max_reproj_px))
    wide = _angle_reached(shuffled(e).join(good.select(*TRACK), TRACK, "left_semi"), math.radians(min_angle_deg))
    return shuffled(shuffled(pts).join(good.select(*TRACK, "mean_error"), TRACK)).join(wide, TRACK, "left_semi")


def _angle_reached(rows: DataFrame, angle: float) -> DataFrame:
    """Tracks with two rays at least `angle` apart.

    Any ray that far from the first one settles a track. The others have all rays within `angle` of the first, and their two
    farthest ones decide.
    """
    ray = [F.col(c) - F.col("t" + c) for c in "xyz"]
    d = rows.withColumn("_n", F.greatest(F.lit(1e-12), R.norm(ray)))
    d = d.select(*TRACK, "frame_id", *[((F.col(c) - F.col("t" + c)) / F.col("_n")).alias("d" + c) for c in "xyz"])
    d = checkpointed(d)
    first = d.groupBy(*TRACK).agg(F.min_by(F.struct("dx", "dy", "dz"), "frame_id").alias("_f"))
    cos0 = R.dot([F.col("d" + c) for c in "xyz"], [F.col(f"_f.d{c}") for c in "xyz"])
    g = shuffled(d).join(first, TRACK).groupBy(*TRACK).agg(F.min(cos0).alias("_c"))
    sure = g.filter(F.col("_c") <= math.cos(angle)).select(*TRACK)
    # Twice the spread from the first ray bounds every pair, so a narrow bundle is settled too.
    open_ = g.filter((F.col("_c") > math.cos(angle)) & (F.col("_c") <= math.cos(angle / 2) + 1e-15)).select(*TRACK)
    # Among unit vectors the widest angle is the longest chord.
    rest = shuffled(d).join(open_, TRACK, "left_semi").select(*TRACK, "frame_id", "dx", "dy", "dz")
    late = farthest_pairs(rest, list(TRACK), ("dx", "dy", "dz"), "frame_id").filter(F.col("distance") >= 2.0 * math.sin(angle / 2.0)).select(*TRACK)
    return sure.unionByName(late)


def verify_landmarks(obs: DataFrame, poses: DataFrame, max_error_px: float = 4.0, min_baseline: float = 0.2) -> DataFrame:
    """Two-view points from the widest pair, checked in all views: adds x, y, z, error and is_inlier per track."""
    posed = checkpointed(_posed(obs, poses))
    pair = checkpointed(widest_pair(obs, poses, min_baseline).select(*TRACK, "frame_id", "frame_id_2"))
    ends = pair.select(*TRACK, "frame_id").unionByName(pair.select(*TRACK, F.col("frame_id_2").alias("frame_id")))
    h = _linear_points(shuffled(posed).join(ends, [*TRACK, "frame_id"], "left_semi"), False).filter(F.abs("hw") >= 1e-8)
    pts = h.select(*TRACK, *[(F.col("h" + c) / F.col("hw")).alias(c) for c in "xyz"])
    e = checkpointed(_errors(posed, pts))
    front = shuffled(e).join(ends, [*TRACK, "frame_id"], "left_semi").groupBy(*TRACK).agg(F.min("zc").alias("_z")).filter(F.col("_z") > 0.1)
    mean = e.filter(F.col("zc") > 0.1).groupBy(*TRACK).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"), F.avg("error").alias("error"))
    return shuffled(mean).join(front.select(*TRACK), TRACK, "left_semi").withColumn("is_inlier", F.col("error") < max_error_px)


def reprojection_errors(obs: DataFrame, poses: DataFrame, landmarks: DataFrame, min_z: float = 0.05) -> DataFrame:
    """Pixel error of every observation of a landmark that lies in front of its camera."""
    return _errors(_posed(obs, poses), landmarks).filter(F.col("zc") > min_z).select(*TRACK, "frame_id", "error")


def prune_observations(obs: DataFrame, poses: DataFrame, landmarks: DataFrame, max_reproj_px: float = 2.0, min_track_len: int = 3) -> DataFrame:
    """Observations left after dropping those beyond the robust error limit and the landmarks that lose their support.

    The limit is median + 4 sigma of all errors of the flight (sigma from the median absolute deviation).
    """
    e = checkpointed(_errors(_posed(obs, poses), landmarks).withColumn("error", F.when(F.col("zc") <= 0.05, 1e9).otherwise(F.col("error"))).select(
        *TRACK, "frame_id", "error", (F.col("zc") > 0.05).alias("_front")))
    seen = e.filter("_front")
    med = checkpointed(exact_quantiles(seen, FLIGHT, "error", {"_med": 0.5}))
    dev = attach(seen, med, FLIGHT, "inner", compute_once=False).withColumn("_dev", F.abs(F.col("error") - F.col("_med")))
    mad = exact_quantiles(dev, FLIGHT, "_dev", {"_mad": 0.5})
    cut = F.greatest(F.lit(max_reproj_px), F.col("_med") + 4.0 * F.greatest(F.col("_mad") * 1.4826, F.lit(0.15)))
    d = attach(e, med.join(mad, FLIGHT).select(FLIGHT, cut.alias("cut")), FLIGHT, "inner").withColumn("_bad", F.col("error") > F.col("cut"))
    n = d.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_bad"), 1).otherwise(0)).alias("_nb"))
    d = checkpointed(d.join(n, TRACK).filter(~F.col("_bad") | (F.col("_n") - F.col("_nb") < min_track_len)).select(*TRACK, "frame_id", "error"))
    mid = exact_quantiles(d, TRACK, "error", {"_m": 0.5}).join(d.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_k")), TRACK)
    keep = mid.filter((F.col("_k") >= 2) & (F.col("_m") <= 2.5 * max_reproj_px)).select(*TRACK)
    return d.join(keep, TRACK, "left_semi")


def thin_observations(obs: DataFrame, max_landmarks: int, max_obs: int) -> DataFrame:
    """The longest tracks of each flight, each thinned to evenly spaced observations."""
    n = checkpointed(obs.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n")).withColumn("_neg", -F.col("n")))
    top = with_rank(range_chunks(n, FLIGHT, ["_neg", "track_id"]), FLIGHT, ["_neg", "track_id"], "_r").filter(F.col("_r") < max_landmarks).select(*TRACK, "n")
    d = obs.join(top, TRACK)
    short = d.filter(F.col("n") <= max_obs).select(*TRACK, "frame_id")
    long = with_rank(range_chunks(d.filter(F.col("n") > max_obs).select(*TRACK, "frame_id"), TRACK, "frame_id"), TRACK, "frame_id", "_i").drop("_chunk")
    picks = top.filter(F.col("n") > max_obs).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(max_obs - 1))))
    picks = picks.select(*TRACK, F.rint(F.col("_k") * ((F.col("n") - 1) / F.lit(float(max_obs - 1)))).cast("long").alias("_i")).distinct()
    return short.unionByName(long.join(picks, [*TRACK, "_i"], "left_semi").select(*TRACK, "frame_id"))
