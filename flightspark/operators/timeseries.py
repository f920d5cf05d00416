"""Telemetry time series: clock units, datum, velocity, as-of interpolation, barometer fusion, pose building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightspark.functions import geodesy, rotation as R
from flightspark.operators.scale import (CHUNK, attach, exact_quantiles, range_chunks, ranked, with_brackets,
                                         with_previous)
from flightspark.session import checkpointed

FLIGHT = "flight_id"
# Candidate clock divisors and the sampling step they are judged by.
DIVISORS = [1.0, 1e3, 1e6, 1e9]
IDEAL_STEP_S = 0.03
LERP_COLS = ["lat", "lon", "alt", "rel_alt", "yaw", "pitch", "roll", "enu_x", "enu_y", "enu_z"]


def clock_divisors(df: DataFrame, by: str = FLIGHT, raw: str = "raw_ts") -> DataFrame:
    """(by, step, divisor): the divisor that brings the median sample step nearest to a believable one."""
    d = df.filter(F.col(raw).isNotNull() & ~F.isnan(F.col(raw).cast("double"))).select(by, F.col(raw).cast("double").alias("_t"))
    steps = with_previous(range_chunks(d, by, "_t"), by, "_t", ["_t"]).select(by, (F.col("_t") - F.col("prev__t")).alias("_d"))
    med = exact_quantiles(steps, by, "_d", {"_med": 0.5})
    ends = d.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    s = ends.join(med, by, "left")
    step = F.when(F.col("_med") > 0, F.col("_med")).otherwise(
        (F.col("_hi") - F.col("_lo")) / F.greatest(F.lit(1.0), F.col("_n") - F.lit(1.0)))
    s = s.withColumn("step", step)

    def cost(div: float) -> Column:
        dt = F.col("step") / div
        return F.when(dt > 0, F.abs(F.log(dt / IDEAL_STEP_S)) + F.when((dt < 1e-4) | (dt > 30), 12.0).otherwise(0.0))

    costs = [cost(div) for div in DIVISORS]
    best = F.least(*costs)
    choice = F.lit(1.0)
    for c, div in reversed(list(zip(costs, DIVISORS))):
        choice = F.when(c == best, div).otherwise(choice)
    return s.select(by, "step", F.when(F.col("_n") < 3, 1.0).otherwise(choice).alias("divisor"))


def normalize_time_unit(df: DataFrame, by: str = FLIGHT, raw: str = "raw_ts", out: str = "ts") -> DataFrame:
    return (attach(df, clock_divisors(df, by, raw).select(by, "divisor"), by)
            .withColumn(out, F.col(raw).cast("double") / F.coalesce("divisor", F.lit(1.0))).drop("divisor"))


def datum(df: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Origin of each flight: its first record in file order."""
    first = F.min_by(F.struct("lat", "lon", "alt"), "rec_no")
    return df.groupBy(by).agg(first.alias("_d")).select(
        by, F.col("_d.lat").alias("ref_lat"), F.col("_d.lon").alias("ref_lon"), F.col("_d.alt").alias("ref_alt"))


def attach_datum(df: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Adds the origin and the local position enu_x, enu_y, enu_z."""
    d = attach(df, datum(df, by), by)
    e, n, u = geodesy.ecef_to_enu(*geodesy.geodetic_to_ecef("lat", "lon", "alt"), "ref_lat", "ref_lon", "ref_alt")
    return d.withColumns({"enu_x": e, "enu_y": n, "enu_z": u})


def velocity_heading(df: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Adds vx, vy, vz and heading from the previous record in file order."""
    d = with_previous(range_chunks(df, by, "rec_no"), by, "rec_no", ["ts", "enu_x", "enu_y", "enu_z"]).drop(CHUNK)
    first = F.col("prev_ts").isNull()
    dt = F.greatest(F.lit(1e-4), F.col("ts") - F.col("prev_ts"))
    dx, dy, dz = (F.col(f"enu_{a}") - F.col(f"prev_enu_{a}") for a in "xyz")
    d = d.withColumns({f"v{a}": F.when(first, 0.0).otherwise(delta / dt) for a, delta in zip("xyz", (dx, dy, dz))})
    turn = F.when(~first & (dx * dx + dy * dy > 0.01), F.degrees(F.atan2(dx, dy))).otherwise(0.0)
    return d.withColumn("heading", turn).drop("prev_ts", "prev_enu_x", "prev_enu_y", "prev_enu_z")


def path_length(df: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Travelled distance, record count and origin of each flight (file order)."""
    d = with_previous(range_chunks(df, by, "rec_no"), by, "rec_no", ["enu_x", "enu_y", "enu_z"])
    step = R.norm([F.col(f"enu_{a}") - F.col(f"prev_enu_{a}") for a in "xyz"])
    return d.groupBy(by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("distance_m"), F.count(F.lit(1)).alias("records"),
                             F.first("ref_lat").alias("ref_lat"), F.first("ref_lon").alias("ref_lon"),
                             F.first("ref_alt").alias("ref_alt"))


def image_index(df: DataFrame, by: str = FLIGHT) -> DataFrame:
    """The record that names each image; the latest in time order wins."""
    cols = [c for c in df.columns if c not in (by, "image_id")]
    best = F.max_by(F.struct(*cols), F.struct("ts", "rec_no"))
    return df.filter(F.col("image_id") > 0).groupBy(by, "image_id").agg(best.alias("_r")).select(by, "image_id", "_r.*")


def interp_asof(queries: DataFrame, records: DataFrame, by: str = FLIGHT, cols: list[str] | None = None,
                max_cols: list[str] = ("unc", "vunc"), wrap: bool = False) -> DataFrame:
    """Record values at the query times `q_ts` (columns by, q_id, q_ts), linear between neighbours, clamped at the ends.

    Queries and records are put in one order and each query looks for its neighbours there, so no range join is built.
    With `wrap` the yaw takes the shorter way round.
    """
    cols = [c for c in (cols or LERP_COLS) if c in records.columns]
    tops = [c for c in max_cols if c in records.columns]
    rec = F.struct(F.col("ts"), F.col("rec_no"), *[F.col(c).cast("double").alias(c) for c in cols + tops])
    last = records.groupBy(by).agg(F.max_by(rec, F.struct("ts", "rec_no")).alias("_final"))
    r = records.select(by, F.col("ts").alias("_o"), F.lit(1).alias("_k"), F.col("rec_no").alias("_i"), rec.alias("_rec"))
    q = queries.select(by, F.col("q_ts").alias("_o"), F.lit(0).alias("_k"), F.col("q_id").cast("long").alias("_i"))
    both = q.unionByName(r, allowMissingColumns=True)
    order = ["_o", "_k", "_i"]
    d = with_brackets(range_chunks(both, by, order), by, order, "_rec").filter(F.col("_k") == 0)
    d = attach(d, last, by)
    at_end = F.col("_o") >= F.col("_final.ts")
    p0 = F.when(at_end, F.col("_final")).otherwise(F.coalesce("_before", "_after"))
    p1 = F.when(at_end, F.col("_final")).otherwise(F.coalesce("_after", "_final"))
    d = d.withColumns({"_p0": p0, "_p1": p1})
    same = (F.col("_p0.ts") == F.col("_p1.ts")) & (F.col("_p0.rec_no") == F.col("_p1.rec_no"))
    alpha = F.when(same, 0.0).otherwise((F.col("_o") - F.col("_p0.ts")) / F.greatest(F.lit(1e-6), F.col("_p1.ts") - F.col("_p0.ts")))
    d = d.withColumn("alpha", alpha)

    def lerp(c: str) -> Column:
        a, b = F.col(f"_p0.{c}"), F.col(f"_p1.{c}")
        if wrap and c == "yaw":
            turn = F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0
            return F.pmod(a + F.col("alpha") * turn, F.lit(360.0))
        return (F.lit(1.0) - F.col("alpha")) * a + F.col("alpha") * b

    return d.filter(F.col("_p0").isNotNull()).select(
        by, F.col("_i").alias("q_id"), F.col("_o").alias("q_ts"), "alpha",
        *[lerp(c).alias(c) for c in cols], *[F.greatest(F.col(f"_p0.{c}"), F.col(f"_p1.{c}")).alias(c) for c in tops])


def smooth_baro(baro: DataFrame, by: str = FLIGHT, block: int = 8192, max_half: int = 99) -> DataFrame:
    """Centred moving mean of about one second, edges padded with the end values.

    Works in blocks of ranks that also hold the neighbouring ranks a mean can reach, so no flight is one group.
    """
    d = ranked(baro, by, ["ts", "rec_no"], "rank")
    ends = d.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), (F.max("ts") - F.min("ts")).alias("_span"),
                             F.min_by("alt", "rank").alias("_a0"), F.max_by("alt", "rank").alias("_a1"))
    win = F.least(F.lit(199.0), F.greatest(F.lit(1.0), F.rint(F.col("_n") / F.greatest(F.lit(1.0), F.greatest(F.lit(1e-6), F.col("_span"))))))
    ends = ends.withColumn("_win", win.cast("int").bitwiseOR(F.lit(1)))
    d = attach(d, ends, by).withColumn("_h", ((F.col("_win") - 1) / 2).cast("long"))
    lo, hi = (F.floor((F.col("rank") + s) / block) for s in (-max_half, max_half))
    d = d.withColumn("_b", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), lo), hi)))
    w = Window.partitionBy(by, "_b").orderBy("rank")
    run = d.withColumn("_run", F.sum("alt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = run.filter(F.floor(F.col("rank") / block) == F.col("_b"))
    at = run.select(by, "_b", F.col("rank").alias("_r"), F.col("_run").alias("_s"))
    top, low = F.least(F.col("rank") + F.col("_h"), F.col("_n") - 1), F.col("rank") - F.col("_h") - 1
    own = own.withColumns({"_top": top, "_low": low})
    j = (own.join(at.select(by, "_b", F.col("_r").alias("_top"), F.col("_s").alias("_st")), [by, "_b", "_top"], "left")
         .join(at.select(by, "_b", F.col("_r").alias("_low"), F.col("_s").alias("_sl")), [by, "_b", "_low"], "left"))
    miss_left = F.greatest(F.lit(0), F.col("_h") - F.col("rank"))
    miss_right = F.greatest(F.lit(0), F.col("rank") + F.col("_h") - (F.col("_n") - 1))
    total = F.col("_st") - F.coalesce("_sl", F.lit(0.0)) + miss_left * F.col("_a0") + miss_right * F.col("_a1")
    return j.select(by, "rec_no", "rank", "ts", (total / F.col("_win")).alias("alt"))


def baro_fuse(telemetry: DataFrame, baro: DataFrame, by: str = FLIGHT, sigma_m: float = 0.35) -> DataFrame:
    """Telemetry with its height channel shaped by the barometer (adds baro_used); needs ts, enu_z, vunc.

    `baro` has by, rec_no, raw_ts, alt. A log with fewer than 8 samples or covering under half the flight is ignored.
    """
    t_ends = telemetry.groupBy(by).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    b = checkpointed(smooth_baro(normalize_time_unit(baro, by), by))
    b_ends = b.groupBy(by).agg(F.min("ts").alias("_b0"), F.max("ts").alias("_b1"), F.count(F.lit(1)).alias("_bn"))
    cover = F.least("_b1", "_t1") - F.greatest("_b0", "_t0")
    usable = t_ends.join(b_ends, by).filter((F.col("_bn") >= 8) & (cover >= 0.5 * (F.col("_t1") - F.col("_t0")))).select(by)
    q = telemetry.select(by, F.col("rec_no").alias("q_id"), F.col("ts").alias("q_ts"))
    sampled = interp_asof(q, b, by, ["alt"], []).select(by, F.col("q_id").alias("rec_no"), F.col("alt").alias("_baro"))
    d = checkpointed(telemetry.join(sampled, [by, "rec_no"], "left"))
    gap = exact_quantiles(d.select(by, (F.col("enu_z") - F.col("_baro")).alias("_g")), by, "_g", {"_offset": 0.5})
    d = attach(d, usable.join(gap, by).select(by, "_offset"), by)
    used = F.col("_offset").isNotNull() & F.col("_baro").isNotNull()
    return (d.withColumn("enu_z", F.when(used, F.col("_baro") + F.col("_offset")).otherwise(F.col("enu_z")))
            .withColumn("vunc", F.when(used, F.lit(sigma_m)).otherwise(F.col("vunc")))
            .withColumn("baro_used", used).drop("_baro", "_offset"))


def bind_by_image_id(frames: DataFrame, telemetry: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Frames (by, frame_id, path, ts) on the clock of the record that names their image, if enough of them match."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    digits = F.regexp_extract_all(stem, F.lit(r"(\d+)"), 1)
    d = frames.withColumn("image_id", F.when(F.size(digits) > 0, F.element_at(digits, -1)).cast("long"))
    idx = image_index(telemetry.select(by, "image_id", "ts", "rec_no"), by).select(by, "image_id", F.col("ts").alias("_rec_ts"))
    d = d.join(idx, [by, "image_id"], "left")
    tally = d.groupBy(by).agg(F.count("_rec_ts").alias("matched"), F.count(F.lit(1)).alias("_n"))
    ok = F.col("matched") >= F.greatest(F.lit(3), F.floor(F.col("_n") * 0.6))
    d = attach(d, tally.select(by, "matched", ok.alias("bound")), by)
    return d.withColumn("ts", F.when(F.col("bound") & F.col("_rec_ts").isNotNull(), F.col("_rec_ts")).otherwise(F.col("ts"))).drop("_rec_ts")


def time_offset(frames: DataFrame, telemetry: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Start of the log minus start of the video."""
    t = telemetry.groupBy(by).agg(F.min("ts").alias("log_start"))
    v = frames.groupBy(by).agg(F.min_by("ts", "frame_id").alias("video_start"))
    return t.join(v, by).withColumn("offset_s", F.col("log_start") - F.col("video_start"))


def interp_pose(queries: DataFrame, poses: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Poses at the query times (columns by, q_id, q_ts): straight-line position, great-circle rotation."""
    src = R.with_quat(poses).select(by, "ts", F.col("frame_id").alias("rec_no"), "tx", "ty", "tz", *R.Q_NAMES)
    rec = F.struct(*[c for c in src.columns if c != by])
    ends = src.groupBy(by).agg(F.max_by(rec, F.struct("ts", "rec_no")).alias("_final"))
    both = queries.select(by, F.col("q_ts").alias("_o"), F.lit(0).alias("_k"), F.col("q_id").cast("long").alias("_i")).unionByName(
        src.select(by, F.col("ts").alias("_o"), F.lit(1).alias("_k"), F.col("rec_no").alias("_i"), rec.alias("_rec")),
        allowMissingColumns=True)
    order = ["_o", "_k", "_i"]
    d = attach(with_brackets(range_chunks(both, by, order), by, order, "_rec").filter(F.col("_k") == 0), ends, by)
    d = d.withColumns({"_p0": F.coalesce("_before", "_after"), "_p1": F.coalesce("_after", "_final")})
    clamp = F.col("_before").isNull() | F.col("_after").isNull()
    d = d.withColumn("alpha", F.when(clamp, F.when(F.col("_after").isNull(), 1.0).otherwise(0.0)).otherwise(
        (F.col("_o") - F.col("_p0.ts")) / F.greatest(F.lit(1e-6), F.col("_p1.ts") - F.col("_p0.ts"))))
    return _between(d, by, "_p0", "_p1", F.col("_i").alias("q_id"), F.col("_o").alias("q_ts"))


def _between(d: DataFrame, by: str, a: str, b: str, *keep: Column) -> DataFrame:
    """Position and rotation at `alpha` between two pose structs."""
    mid = R.with_slerp(d, a, b, "alpha")
    rot = R.quat_to_rot([F.col(n) for n in R.Q_NAMES])
    pos = [((F.lit(1.0) - F.col("alpha")) * F.col(f"{a}.{t}") + F.col("alpha") * F.col(f"{b}.{t}")).alias(t) for t in ("tx", "ty", "tz")]
    return mid.select(by, *keep, "alpha", *[c.alias(n) for c, n in zip(rot, R.R_NAMES)], *pos)


def fill_missing_poses(frames: DataFrame, poses: DataFrame, by: str = FLIGHT) -> DataFrame:
    """A pose for every frame (by, frame_id): registered ones as they are, others interpolated by frame number.

    cov is the scale of the identity covariance: 0.25 between neighbours, 0.5 beyond the ends, null when registered.
    """
    src = R.with_quat(poses).select(by, "frame_id", F.struct("frame_id", "tx", "ty", "tz", *R.R_NAMES, *R.Q_NAMES).alias("_rec"))
    d = frames.select(by, "frame_id").join(src, [by, "frame_id"], "left")
    d = with_brackets(range_chunks(d, by, "frame_id"), by, "frame_id", "_rec")
    d = d.withColumns({"_p0": F.coalesce("_before", "_after"), "_p1": F.coalesce("_after", "_before")})
    span = F.col("_p1.frame_id") - F.col("_p0.frame_id")
    d = d.withColumn("alpha", F.when(span > 0, (F.col("frame_id") - F.col("_p0.frame_id")) / span).otherwise(0.0))
    known = F.col("_rec").isNotNull()
    cov = F.when(known, F.lit(None)).when(F.col("_before").isNull() | F.col("_after").isNull(), 0.5).otherwise(0.25).cast("double")
    out = _between(d.filter(F.col("_p0").isNotNull()), by, "_p0", "_p1", F.col("frame_id"), cov.alias("cov"), known.alias("registered"),
                   F.col("_rec").alias("_rec"))
    fixed = {n: F.coalesce(F.col(f"_rec.{n}"), F.col(n)) for n in R.R_NAMES}
    return out.withColumns(fixed).drop("_rec", "alpha")


def pose_from_telemetry(frames: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Initial pose per frame (by, frame_id, idx, enu_x.., yaw, pitch, roll, unc; nulls where no telemetry exists)."""
    known = F.col("enu_x").isNotNull()
    rot = R.body_to_camera_rotation("yaw", "pitch", "roll")
    # The rotation used without telemetry.
    fallback = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0]
    return frames.select(
        by, "frame_id", *[F.when(known, c).otherwise(F.lit(f)).alias(n) for c, f, n in zip(rot, fallback, R.R_NAMES)],
        F.when(known, F.col("enu_x")).otherwise(F.col("idx") * 0.5).alias("tx"),
        F.when(known, F.col("enu_y")).otherwise(0.0).alias("ty"), F.when(known, F.col("enu_z")).otherwise(10.0).alias("tz"),
        F.when(known, F.lit(1.0) / F.greatest(F.lit(0.1), F.col("unc"))).otherwise(0.0).alias("gps_w"))


def gps_residual(poses: DataFrame, records: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Distance of every pose from the interpolated telemetry position."""
    at = interp_asof(poses.select(by, F.col("frame_id").alias("q_id"), F.col("ts").alias("q_ts")), records, by,
                     ["enu_x", "enu_y", "enu_z"], [])
    d = poses.join(at.withColumnRenamed("q_id", "frame_id"), [by, "frame_id"])
    return d.select(by, "frame_id", R.norm([F.col("tx") - F.col("enu_x"), F.col("ty") - F.col("enu_y"),
                                            F.col("tz") - F.col("enu_z")]).alias("residual_m"))


def trajectory_residuals(poses: DataFrame, reprojection: DataFrame | None = None, by: str = FLIGHT, gps_weight: float = 10.0,
                         smoothness: float = 2.0, visual: float = 0.1, huber: float = 2.0) -> DataFrame:
    """Residual rows (by, frame_id, factor, axis, residual, weight) of a trajectory against its evidence.

    `poses` has ts, tx..tz, r00..r22, gps_x..gps_z, gps_w; `reprojection` has frame_id, du, dv in pixels.
    """
    p = R.with_rotation_vector(poses)
    state = ["ts", "tx", "ty", "tz", "wx", "wy", "wz"]
    ranked_p = checkpointed(ranked(p, by, "frame_id", "_i"))
    side = ranked_p.select(by, "_i", F.struct(*state).alias("_s"))
    d = (ranked_p.join(side.select(by, (F.col("_i") + 1).alias("_i"), F.col("_s").alias("_l")), [by, "_i"], "left")
         .join(side.select(by, (F.col("_i") - 1).alias("_i"), F.col("_s").alias("_n")), [by, "_i"], "left"))
    dt1 = F.greatest(F.lit(1e-3), F.col("ts") - F.col("_l.ts"))
    dt2 = F.greatest(F.lit(1e-3), F.col("_n.ts") - F.col("ts"))
    rows = []
    for a in "xyz":
        rows.append(("gps", a, F.when(F.col("gps_w") > 0, (F.col(f"t{a}") - F.col(f"gps_{a}")) * gps_weight * F.col("gps_w"))))
        rows.append(("acceleration", a, ((F.col(f"_n.t{a}") - F.col(f"t{a}")) / dt2 - (F.col(f"t{a}") - F.col(f"_l.t{a}")) / dt1) * smoothness))
        rows.append(("rotation", a, (F.col(f"_n.w{a}") - 2 * F.col(f"w{a}") + F.col(f"_l.w{a}")) * (smoothness * 0.5)))
    items = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(a).alias("axis"), r.alias("residual")) for f, a, r in rows])
    out = d.select(by, "frame_id", F.explode(items).alias("_x")).select(by, "frame_id", "_x.*").filter(F.col("residual").isNotNull())
    if reprojection is not None:
        out = out.unionByName(reprojection.select(by, "frame_id", F.explode(F.array(
            F.struct(F.lit("reprojection").alias("factor"), F.lit("u").alias("axis"), (F.col("du") * visual).alias("residual")),
            F.struct(F.lit("reprojection").alias("factor"), F.lit("v").alias("axis"), (F.col("dv") * visual).alias("residual"))
        )).alias("_x")).select(by, "frame_id", "_x.*"))
    return out.withColumn("weight", F.when(F.abs("residual") <= huber, 1.0).otherwise(F.lit(huber) / F.abs("residual")))


def scale_agreement(telemetry: DataFrame, truth: DataFrame, by: str = FLIGHT, records: int | None = None) -> DataFrame:
    """GPS and ground-truth distance between the first and the last record (or the n-th, if given), and their difference."""
    t, g = telemetry.withColumn("_k", F.col("rec_no")), truth.withColumn("_k", F.col("imgid"))
    if records is not None:
        w = Window.partitionBy(by)
        t = t.withColumn("_n", F.row_number().over(w.orderBy("_k"))).filter(F.col("_n") <= records)
        g = g.withColumn("_n", F.row_number().over(w.orderBy("_k"))).filter(F.col("_n") <= records)

    def ends(d: DataFrame, cols: list[str], name: str) -> DataFrame:
        e = d.groupBy(by).agg(F.min_by(F.struct(*cols), "_k").alias("_a"), F.max_by(F.struct(*cols), "_k").alias("_b"))
        return e.select(by, R.norm([F.col(f"_b.{c}") - F.col(f"_a.{c}") for c in cols]).alias(name))

    d = ends(t, ["enu_x", "enu_y", "enu_z"], "gps_m").join(ends(g, ["x_gt", "y_gt", "z_gt"], "truth_m"), by)
    return d.withColumn("difference_m", F.abs(F.col("gps_m") - F.col("truth_m")))


def route_summary(points: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Bounding box, centre, spans, aspect, duration and mean height of a route (by, rec_no, lat, lon, alt, ts)."""
    d = points.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        (F.max_by("ts", "rec_no") - F.min_by("ts", "rec_no")).alias("duration_s"), F.avg("alt").alias("mean_alt"))
    lat_span, lon_span = F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min")
    return d.withColumns({"lat_centre": (F.col("lat_min") + F.col("lat_max")) / 2, "lon_centre": (F.col("lon_min") + F.col("lon_max")) / 2,
                          "lat_span": lat_span, "lon_span": lon_span,
                          "aspect": lon_span / F.when(lat_span == 0, 0.0001).otherwise(lat_span)})


def active_segment(points: DataFrame, upto, by: str = FLIGHT) -> DataFrame:
    """Route points up to the frame `upto` (a column or a number) with the share of the route they cover."""
    d = ranked(points, by, "rec_no", "frame")
    d = attach(d, d.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), by)
    k = F.greatest(F.lit(0), F.least(upto if isinstance(upto, Column) else F.lit(upto), F.col("_n") - 1))
    ratio = F.when(F.col("_n") > 1, k / (F.col("_n") - 1)).otherwise(0.0)
    captured = F.floor(ratio * 100 + 0.5)
    return (d.filter(F.col("frame") <= k).withColumns({"captured_pct": captured, "coverage_pct": F.least(
        F.lit(100), F.floor(captured * 0.95 + 0.5))}).drop("_n"))
