"""Metric alignment of many flights at once: similarity fits, robust refits, flight axis, roll, registration.

Every fit is a handful of sums per flight; only those few numbers reach Python, where the 3 x 3 problems of a whole batch
of flights are solved together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.functions import rotation as R
from flightspark.operators.grid import nearest_neighbor
from flightspark.operators.scale import attach, exact_quantiles
from flightspark.session import checkpointed

FLIGHT = "flight_id"
S, D = ("sx", "sy", "sz"), ("dx", "dy", "dz")
FIT = ["scale", *R.R_NAMES, "t0", "t1", "t2"]
FIT_SCHEMA = "flight_id long, n long, " + ", ".join(f"{c} double" for c in FIT)
UP = (0.0, 0.0, 1.0)


def _weighted_sums(pairs: DataFrame, w: Column, by: str = FLIGHT) -> DataFrame:
    """Weight, means, cross moments and source moment of each flight; means are taken first so the moments stay exact."""
    d = pairs.withColumn("_w", w)
    mean = d.groupBy(by).agg(F.sum("_w").alias("sw"), F.count(F.lit(1)).alias("n"), *[(F.sum(F.col("_w") * F.col(c)) / F.greatest(F.lit(1e-12), F.sum("_w"))).alias("m_" + c) for c in S + D])
    mean = checkpointed(mean)
    c = attach(d, mean, by, "inner", compute_once=False)
    cen = {k: F.col(k) - F.col("m_" + k) for k in S + D}
    wn = F.col("_w") / F.greatest(F.lit(1e-12), F.col("sw"))
    mom = c.groupBy(by).agg(*[F.sum(wn * cen[D[i]] * cen[S[j]]).alias(f"c{i}{j}") for i in range(3) for j in range(3)],
                            F.sum(wn * sum((cen[k] * cen[k] for k in S[1:]), cen[S[0]] * cen[S[0]])).alias("var_s"))
    return mean.join(mom, by)


def _rotations(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(cov)
    sign = np.ones((len(cov), 3))
    sign[:, 2] = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    return u @ (sign[:, :, None] * vt), (s * sign).sum(axis=1)


def _solve(rigid: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            cov = pdf[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
            rot, tr = _rotations(cov)
            scale = np.ones(len(pdf)) if rigid else tr / np.maximum(1e-12, pdf["var_s"].to_numpy())
            ms, md = (pdf[["m_" + c for c in cols]].to_numpy() for cols in (S, D))
            t = md - scale[:, None] * np.einsum("nij,nj->ni", rot, ms)
            out = pd.DataFrame({"flight_id": pdf["flight_id"], "n": pdf["n"], "scale": scale})
            for k, name in enumerate(R.R_NAMES):
                out[name] = rot.reshape(-1, 9)[:, k]
            for k in range(3):
                out[f"t{k}"] = t[:, k]
            yield out
    return run


def umeyama(pairs: DataFrame, weight: Column | None = None, rigid: bool = False) -> DataFrame:
    """Weighted similarity dst ~ scale * R * src + t per flight (columns sx..sz, dx..dz)."""
    return _weighted_sums(pairs, weight if weight is not None else F.lit(1.0)).mapInPandas(_solve(rigid), FIT_SCHEMA)


def _moved(d: DataFrame) -> list[Column]:
    r = R.apply(R.r_cols("f_"), [F.col(c) for c in S])
    return [F.col("f_scale") * c + F.col(f"f_t{i}") for i, c in enumerate(r)]


def _with_fit(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    d = attach(pairs, fit.select(FLIGHT, *[F.col(c).alias("f_" + c) for c in FIT]), FLIGHT, "inner")
    return d.withColumn("_resid", R.norm([m - F.col(c) for m, c in zip(_moved(d), D)]))


def _robust_limit(d: DataFrame, value: str, floor: float = 2.0) -> DataFrame:
    """max(floor, median + 2 sigma) of a residual per flight, sigma from the median absolute deviation."""
    med = checkpointed(exact_quantiles(d, FLIGHT, value, {"_med": 0.5}))
    dev = attach(d, med, FLIGHT, "inner", compute_once=False).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = exact_quantiles(dev, FLIGHT, "_dev", {"_mad": 0.5})
    lim = F.greatest(F.lit(floor), F.col("_med") + 2.0 * F.greatest(F.col("_mad") * 1.4826, F.lit(0.5)))
    return med.join(mad, FLIGHT).select(FLIGHT, lim.alias("_lim"))


def align_gps_irls(pairs: DataFrame, passes: int = 6, min_frames: int = 4) -> DataFrame:
    """Similarity fit that ignores gross GPS jumps; pairs carry sig and sig_z. Adds rmse, median residual, disagreement."""
    enough = pairs.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_frames).select(FLIGHT)
    p = attach(pairs, enough, FLIGHT, "left_semi")
    p = checkpointed(p.withColumns({"sig": F.greatest(F.lit(0.5), F.coalesce("sig", F.lit(5.0)))}).withColumn(
        "sig_z", F.greatest(F.lit(0.05), F.coalesce("sig_z", "sig"))).withColumn("w", F.lit(1.0) / F.col("sig")))
    fit = checkpointed(umeyama(p, F.col("w")))
    for _ in range(passes):
        d = checkpointed(_with_fit(p.drop("w"), fit))
        lim = _robust_limit(d, "_resid")
        w = F.when(F.col("_resid") <= F.col("_lim"), 1.0).otherwise(F.col("_lim") / F.greatest(F.lit(1e-6), F.col("_resid"))) / F.col("sig")
        p = checkpointed(attach(d, lim, FLIGHT, "inner").withColumn("w", w).select(*pairs.columns, "w"))
        fit = checkpointed(umeyama(p, F.col("w")))
    aniso = scale_anisotropic(p, fit)
    ratio = F.col("aniso") / F.greatest(F.lit(1e-9), F.col("scale"))
    m = p.groupBy(FLIGHT).agg(*[(F.sum(F.col("w") * F.col(c)) / F.greatest(F.lit(1e-12), F.sum("w"))).alias("m_" + c) for c in S + D])
    f = fit.join(aniso, FLIGHT, "left").join(m, FLIGHT).withColumn("_use", F.coalesce((ratio > 0.02) & (ratio < 50.0), F.lit(False)))
    f = f.withColumn("scale", F.when(F.col("_use"), F.col("aniso")).otherwise(F.col("scale")))
    turned = R.apply(R.r_cols(), [F.col("m_" + c) for c in S])
    f = f.withColumns({f"t{i}": F.when(F.col("_use"), F.col("m_" + D[i]) - F.col("scale") * turned[i]).otherwise(F.col(f"t{i}")) for i in range(3)})
    f = checkpointed(f.select(FLIGHT, "n", *FIT))
    d = checkpointed(_with_fit(p, f))
    stats = d.groupBy(FLIGHT).agg(F.sqrt(F.avg(F.col("_resid") * F.col("_resid"))).alias("rmse_m")).join(
        exact_quantiles(d, FLIGHT, "_resid", {"median_m": 0.5}), FLIGHT)
    return f.join(stats, FLIGHT).join(scale_observability(p, f).select(FLIGHT, "disagreement"), FLIGHT, "left")


def _centred(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    """Adds a0..a2 (turned source) and b0..b2 (target) about their weighted means; pairs carry w."""
    m = checkpointed(pairs.groupBy(FLIGHT).agg(*[(F.sum(F.col("w") * F.col(c)) / F.greatest(F.lit(1e-12), F.sum("w"))).alias("m_" + c) for c in S + D]).join(
        fit.select(FLIGHT, *[F.col(c).alias("f_" + c) for c in R.R_NAMES]), FLIGHT))
    d = attach(pairs, m, FLIGHT, "inner", compute_once=False)
    a = R.apply(R.r_cols("f_"), [F.col(c) - F.col("m_" + c) for c in S])
    return d.withColumns({f"a{i}": c for i, c in enumerate(a)} | {f"b{i}": F.col(c) - F.col("m_" + c) for i, c in enumerate(D)})


def scale_anisotropic(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    """Scale with the vertical axis weighted by its own precision (pairs carry w, sig, sig_z); null when it makes no sense."""
    d = _centred(pairs, fit)
    ph, pz = (F.lit(1.0) / F.greatest(F.lit(1e-6), F.col(c) * F.col(c)) * F.col("w") * F.col("sig") for c in ("sig", "sig_z"))
    num = F.sum(ph * (F.col("a0") * F.col("b0") + F.col("a1") * F.col("b1")) + pz * F.col("a2") * F.col("b2"))
    den = F.sum(ph * (F.col("a0") * F.col("a0") + F.col("a1") * F.col("a1")) + pz * F.col("a2") * F.col("a2"))
    g = d.groupBy(FLIGHT).agg(num.alias("_num"), den.alias("_den"))
    return g.select(FLIGHT, F.when((F.col("_den") > 1e-12) & (F.col("_num") > 0), F.col("_num") / F.col("_den")).alias("aniso"))


def scale_observability(pairs: DataFrame, fit: DataFrame, limit: float = 0.15) -> DataFrame:
    """Scale from the horizontal and from the height channel, their disagreement and whether it is alarming."""
    d = _centred(pairs, fit)
    num_h, den_h = F.col("a0") * F.col("b0") + F.col("a1") * F.col("b1"), F.col("a0") * F.col("a0") + F.col("a1") * F.col("a1")
    g = d.groupBy(FLIGHT).agg(F.sum(num_h).alias("nh"), F.sum(den_h).alias("dh"), F.sum(F.col("a2") * F.col("b2")).alias("nz"), F.sum(F.col("a2") * F.col("a2")).alias("dz"),
                              F.hypot(F.max("b0") - F.min("b0"), F.max("b1") - F.min("b1")).alias("extent_h"), (F.max("b2") - F.min("b2")).alias("extent_z"))
    sh, sz = (F.when((F.col(den) > 1e-9) & (F.col(num) > 0), F.col(num) / F.col(den)) for num, den in (("nh", "dh"), ("nz", "dz")))
    g = g.select(FLIGHT, sh.alias("scale_h"), sz.alias("scale_z"), "extent_h", "extent_z")
    both = F.col("scale_h").isNotNull() & F.col("scale_z").isNotNull()
    spread = F.when(both, F.abs(F.col("scale_h") - F.col("scale_z")) / F.greatest(F.abs("scale_h"), F.abs("scale_z"), F.lit(1e-9)))
    return g.withColumn("disagreement", spread).withColumn("flagged", F.coalesce(F.col("disagreement") > limit, F.lit(False)))


def apply_similarity(df: DataFrame, fit: DataFrame, poses: bool = True) -> DataFrame:
    """Poses (r00.., tx..) or points (x, y, z) moved by scale, R and t of their flight."""
    d = attach(df, fit.select(FLIGHT, *[F.col(c).alias("f_" + c) for c in FIT]), FLIGHT, "inner")
    pos = ("tx", "ty", "tz") if poses else ("x", "y", "z")
    moved = R.apply(R.r_cols("f_"), [F.col(c) for c in pos])
    new = {p: F.col("f_scale") * m + F.col(f"f_t{i}") for i, (p, m) in enumerate(zip(pos, moved))}
    if poses:
        new |= dict(zip(R.R_NAMES, R.matmul(R.r_cols("f_"), R.r_cols())))
    return d.withColumns(new).select(*df.columns)


def _axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf) == 0:
            continue
        m = np.zeros((len(pdf), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                m[:, i, j] = m[:, j, i] = pdf[f"c{i}{j}"].to_numpy()
        val, vec = np.linalg.eigh(m)
        ax = vec[:, :, 2]
        lead = np.take_along_axis(ax, np.abs(ax).argmax(axis=1)[:, None], axis=1)
        ax = ax * np.where(lead < 0, -1.0, 1.0)
        out = pdf[["flight_id", "cx", "cy", "cz"]].copy()
        for k, c in enumerate(("ax", "ay", "az")):
            out[c] = ax[:, k]
        out["straightness"] = val[:, 2] / np.maximum(1e-12, val.sum(axis=1))
        yield out


def flight_axis(poses: DataFrame, min_frames: int = 4) -> DataFrame:
    """Main direction (largest component positive), centroid and straightness of each flight's camera path."""
    t = ("tx", "ty", "tz")
    mean = checkpointed(poses.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for c, k in zip(t, ("cx", "cy", "cz"))]).filter(F.col("n") >= min_frames))
    d = attach(poses.select(FLIGHT, *t), mean, FLIGHT, "inner", compute_once=False)
    cen = [F.col(c) - F.col(k) for c, k in zip(t, ("cx", "cy", "cz"))]
    cov = d.groupBy(FLIGHT).agg(*[(F.sum(cen[i] * cen[j]) / (F.count(F.lit(1)) - 1)).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])
    return mean.join(cov, FLIGHT).mapInPandas(_axes, "flight_id long, cx double, cy double, cz double, ax double, ay double, az double, straightness double")


def refit_translation(pairs: DataFrame, passes: int = 4, min_frames: int = 3) -> DataFrame:
    """Shift d0..d2 per flight with rotation and scale frozen; sig and sig_z give the weights, the vertical keeps its own."""
    enough = pairs.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_frames).select(FLIGHT)
    p = attach(pairs, enough, FLIGHT, "left_semi").withColumns({"w": F.lit(1.0) / F.greatest(F.lit(0.5), F.coalesce("sig", F.lit(5.0)))})
    p = checkpointed(p.withColumn("wz", F.lit(1.0) / F.greatest(F.lit(0.05), F.coalesce("sig_z", F.lit(1.0) / F.greatest(F.lit(1e-9), F.col("w"))))))
    cols = [*pairs.columns, "w", "wz"]
    gap = [F.col(d) - F.col(s) for s, d in zip(S, D)]
    for k in range(passes):
        shift = p.groupBy(FLIGHT).agg(*[(F.sum(F.col("w") * gap[i]) / F.greatest(F.lit(1e-12), F.sum("w"))).alias(f"d{i}") for i in (0, 1)],
                                      (F.sum(F.col("wz") * gap[2]) / F.greatest(F.lit(1e-12), F.sum("wz"))).alias("d2"))
        shift = checkpointed(shift)
        d = attach(p, shift, FLIGHT, "inner", compute_once=False)
        d = checkpointed(d.withColumn("_resid", R.norm([F.col(s) + F.col(f"d{i}") - F.col(t) for i, (s, t) in enumerate(zip(S, D))])))
        if k < passes - 1:
            d = attach(d, _robust_limit(d, "_resid"), FLIGHT, "inner")
            w = F.when(F.col("_resid") <= F.col("_lim"), F.col("w")).otherwise(F.col("w") * F.col("_lim") / F.greatest(F.lit(1e-6), F.col("_resid")))
            p = checkpointed(d.withColumn("w", w).select(*cols))
    stats = d.groupBy(FLIGHT).agg(F.sqrt(F.avg(F.col("_resid") * F.col("_resid"))).alias("rmse_m")).join(exact_quantiles(d, FLIGHT, "_resid", {"median_m": 0.5}), FLIGHT)
    return shift.join(stats, FLIGHT)


def axis_rotation(axis: list[Column], angle: Column) -> list[Column]:
    """Rotation matrix about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    k = F.lit(1.0) - c
    x, y, z = axis
    return [c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k]


def resolve_roll(poses: DataFrame, landmarks: DataFrame, planes: DataFrame | None = None, min_straightness: float = 0.90, min_turn_deg: float = 0.25) -> DataFrame:
    """Rotation about the flight line that levels the scene, per straight flight (a similarity: scale, r00.., t0..).

    `planes` gives the upward normal of a flight's dominant plane (nx, ny, nz); without one the mean optical axis is turned
    downward. Of the two angles that level the scene, the one that puts it farther below the cameras is taken.
    """
    ax = flight_axis(poses).filter(F.col("straightness") >= min_straightness)
    optic = poses.groupBy(FLIGHT).agg(*[F.avg(c).alias("_o" + k) for c, k in (("r02", "x"), ("r12", "y"), ("r22", "z"))])
    d = ax.join(optic, FLIGHT)
    d = d.join(planes.select(FLIGHT, "nx", "ny", "nz"), FLIGHT, "left") if planes is not None else d.withColumns({c: F.lit(None).cast("double") for c in ("nx", "ny", "nz")})
    a = [F.col(c) for c in ("ax", "ay", "az")]

    def turn(vec: list[Column], target: list[Column]) -> Column:
        flat = lambda v: [p - R.dot(v, a) * q for p, q in zip(v, a)]
        v, t = flat(vec), flat(target)
        ok = (R.norm(v) >= 1e-6) & (R.norm(t) >= 1e-6)
        return F.when(ok, F.atan2(R.dot(R.cross(v, t), a), R.dot(v, t)))

    up = [F.lit(u) for u in UP]
    by_plane = F.when(F.col("nx").isNotNull(), turn([F.col(c) for c in ("nx", "ny", "nz")], up))
    by_axis = turn([F.col("_o" + c) for c in "xyz"], [-u for u in up])
    d = d.withColumns({"_plane": by_plane, "_axis": by_axis}).withColumn("theta", F.coalesce("_plane", "_axis")).filter(F.col("theta").isNotNull())
    d = checkpointed(d.withColumn("from_plane", F.col("_plane").isNotNull()).select(FLIGHT, "ax", "ay", "az", "cx", "cy", "cz", "straightness", "theta", "from_plane"))
    # A half turn about the axis mirrors the height across the axis, so both candidates follow from two sets of heights.
    two = d.withColumn("cand", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("angle", F.col("theta") + F.col("cand") * F.lit(np.pi))
    row = axis_rotation(a, F.col("angle"))[6:9]
    two = checkpointed(two.withColumns({f"_z{i}": c for i, c in enumerate(row)}))
    key = [FLIGHT, "cand"]

    def height(df: DataFrame, cols: tuple[str, str, str]) -> DataFrame:
        h = attach(df.select(FLIGHT, *cols), two.select(*key, "_z0", "_z1", "_z2"), FLIGHT, "inner", compute_once=False)
        return h.select(*key, R.dot([F.col(f"_z{i}") for i in range(3)], [F.col(c) for c in cols]).alias("_h"))

    cams = exact_quantiles(height(poses, ("tx", "ty", "tz")), key, "_h", {"_hc": 0.5})
    pts = exact_quantiles(height(landmarks, ("x", "y", "z")), key, "_h", {"_hp": 0.5})
    best = cams.join(pts, key).withColumn("drop", F.col("_hc") - F.col("_hp")).groupBy(FLIGHT).agg(F.max_by(F.struct("cand", "drop"), F.struct("drop", -F.col("cand"))).alias("_b"))
    d = d.join(best.select(FLIGHT, "_b.*"), FLIGHT).withColumn("angle", F.col("theta") + F.col("cand") * F.lit(np.pi))
    d = d.filter(F.abs(F.degrees("angle")) >= min_turn_deg)
    d = d.withColumns(dict(zip(R.R_NAMES, axis_rotation(a, F.col("angle")))))
    pivot = [F.col(c) for c in ("cx", "cy", "cz")]
    turned = R.apply(R.r_cols(), pivot)
    return d.withColumns({f"t{i}": p - q for i, (p, q) in enumerate(zip(pivot, turned))}).select(
        FLIGHT, F.degrees("angle").alias("roll_deg"), "straightness", "from_plane", "drop", F.lit(1.0).alias("scale"), *R.R_NAMES, "t0", "t1", "t2")


def icp_register(source: DataFrame, target: DataFrame, max_distance: float = 0.5, max_iterations: int = 30, tolerance: float = 0.001,
                 min_points: int = 50, min_pairs: int = 20, max_angle_deg: float = 2.0, max_shift: float = 0.20) -> DataFrame:
    """Small rigid correction of a source cloud onto a target cloud per flight: R, t, iterations and mean pair distance.

    All flights iterate together and leave the loop one by one as they settle. A correction beyond the limits is replaced
    by the identity; a flight with too few points keeps it from the start. `source` has s_id, x..z; `target` element_id.
    """
    cols = [*R.R_NAMES, "t0", "t1", "t2"]
    ident = dict(zip(cols, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]))
    src, tgt = checkpointed(source.select(FLIGHT, "s_id", "x", "y", "z")), checkpointed(target.select(FLIGHT, "element_id", "x", "y", "z"))
    sizes = src.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("_ns")).join(tgt.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("_nt")), FLIGHT, "left")
    enough = (F.col("_ns") >= min_points) & (F.coalesce("_nt", F.lit(0)) >= min_points)
    state = checkpointed(sizes.select(FLIGHT, *[F.lit(v).alias(c) for c, v in ident.items()], F.lit(0).alias("iterations"), F.lit(None).cast("double").alias("mean_m"), enough.alias("_go")))
    tpos = tgt.select(FLIGHT, "element_id", *[F.col(c).alias("d" + c) for c in "xyz"])
    for _ in range(max_iterations):
        live = state.filter("_go")
        if live.limit(1).count() == 0:
            break
        d = attach(src, live.select(FLIGHT, *cols), FLIGHT, "inner", compute_once=False)
        moved = [c + F.col(f"t{i}") for i, c in enumerate(R.apply(R.r_cols(), [F.col(c) for c in "xyz"]))]
        q = checkpointed(d.select(FLIGHT, "s_id", *[m.alias(c) for m, c in zip(moved, "xyz")]))
        near = nearest_neighbor(q, tgt, "s_id", "element_id", max_distance, max_radius=max_distance).filter(F.col("distance") < max_distance)
        pairs = q.select(FLIGHT, "s_id", *[F.col(c).alias("s" + c) for c in "xyz"]).join(near, [FLIGHT, "s_id"]).join(tpos, [FLIGHT, "element_id"])
        pairs = checkpointed(pairs)
        fit = umeyama(pairs, rigid=True).select(FLIGHT, F.col("n").alias("_n"), *[F.col(c).alias("u_" + c) for c in cols])
        mean = pairs.groupBy(FLIGHT).agg(F.avg("distance").alias("_mean"))
        j = state.join(fit.join(mean, FLIGHT), FLIGHT, "left")
        step = F.col("_go") & (F.coalesce("_n", F.lit(0)) >= min_pairs)
        rot = R.matmul(R.r_cols("u_"), R.r_cols())
        tr = [c + F.col(f"u_t{i}") for i, c in enumerate(R.apply(R.r_cols("u_"), [F.col(f"t{i}") for i in range(3)]))]
        new = {c: F.when(step, v).otherwise(F.col(c)) for c, v in zip(cols, rot + tr)}
        settled = F.coalesce(F.abs(F.col("mean_m") - F.col("_mean")) < tolerance, F.lit(False))
        state = checkpointed(j.select(FLIGHT, *[v.alias(c) for c, v in new.items()], (F.col("iterations") + F.when(step, 1).otherwise(0)).alias("iterations"),
                                      F.when(step, F.col("_mean")).otherwise(F.col("mean_m")).alias("mean_m"), (step & ~settled).alias("_go")))
    trace = F.least(F.lit(3.0), F.greatest(F.lit(-1.0), F.col("r00") + F.col("r11") + F.col("r22")))
    off = (F.degrees(F.acos((trace - 1.0) / 2.0)) > max_angle_deg) | (R.norm([F.col(f"t{i}") for i in range(3)]) > max_shift)
    state = state.withColumn("rejected", off)
    return state.select(FLIGHT, *[F.when(F.col("rejected"), v).otherwise(F.col(c)).alias(c) for c, v in ident.items()], "iterations", "mean_m", "rejected")
