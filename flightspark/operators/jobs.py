"""Quality gates, stage timings, artifact audits and mission look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightspark.operators.scale import attach, range_chunks, ranked, with_previous

FLIGHT = "flight_id"
# Files a finished job leaves behind.
EXPECTED_FILES = ["model.glb", "model.ply", "model.obj", "texture.png", "trajectory.json", "cameras.json", "world.json", "uncertainty.json",
                  "overlay.json", "quality.json", "report.json", "diagnostics.json"]


def qa_gates(residuals: DataFrame, surfels: DataFrame, mesh: DataFrame, texture: DataFrame | None = None, max_drift: float = 2.5,
             min_support: float = 0.65, max_error_px: float = 3.0, min_faces: int = 200, min_texture: float = 0.75) -> DataFrame:
    """Trajectory, geometry, mesh and texture gates with the overall verdict per flight.

    `residuals` has residual_m per pose; `mesh` faces, degenerate, non_manifold per flight; `texture` coverage per flight.
    """
    r = residuals.groupBy(FLIGHT).agg(F.avg("residual_m").alias("mean_gps_residual_m"))
    p = lambda v: F.sum(F.when(F.col("provenance") == v, 1).otherwise(0))
    s = surfels.groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("elements"), p("OBSERVED").alias("_o"), p("MULTI_VIEW_SUPPORTED").alias("_m"), p("STRUCTURAL_INFERRED").alias("_s"),
                                    p("GENERATIVE_INFERRED").alias("_g"), F.avg(F.when(F.col("reprojection_error") > 0, F.col("reprojection_error"))).alias("_e"))
    tot = F.greatest(F.lit(1), F.col("_o") + F.col("_m") + F.col("_s") + F.col("_g"))
    d = s.join(r, FLIGHT, "left").join(mesh, FLIGHT, "left")
    d = d.join(texture.select(FLIGHT, "coverage"), FLIGHT, "left") if texture is not None else d.withColumn("coverage", F.lit(None).cast("double"))
    d = d.withColumns({"mean_gps_residual_m": F.coalesce("mean_gps_residual_m", F.lit(0.0)), "mean_reprojection_error": F.coalesce("_e", F.lit(1.0)),
                       "support_ratio": (F.col("_o") + F.col("_m")) / tot, "observed_percent": F.col("_o") / tot * 100.0, "multi_view_percent": F.col("_m") / tot * 100.0,
                       "structural_percent": F.col("_s") / tot * 100.0, "generative_percent": F.col("_g") / tot * 100.0})
    known = F.col("observed_percent") + F.col("multi_view_percent") + F.col("structural_percent") + F.col("generative_percent")
    d = d.withColumns({
        "unknown_percent": F.greatest(F.lit(0.0), 100.0 - known),
        "trajectory_passed": F.col("mean_gps_residual_m") <= max_drift,
        "geometry_passed": (F.col("support_ratio") >= min_support * 0.5) & (F.col("mean_reprojection_error") <= max_error_px * 1.5),
        "mesh_passed": (F.coalesce("faces", F.lit(0)) >= min_faces) & (F.coalesce("degenerate", F.lit(0)) == 0) & (F.coalesce("non_manifold", F.lit(0)) == 0),
        "texture_passed": F.coalesce(F.col("coverage") >= min_texture, F.lit(False))})
    ok = F.col("trajectory_passed") & F.col("geometry_passed") & F.col("mesh_passed") & (F.col("texture_passed") | F.col("coverage").isNull())
    return d.withColumn("quality_status", F.when(ok, "PASSED").otherwise("FLAGGED")).drop("_o", "_m", "_s", "_g", "_e")


def stage_durations(events: DataFrame, by: str = "job_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Seconds spent per stage of each job (by, ts, seq, kind, stage); starting a stage ends the one before it."""
    e = events.filter(F.col("kind").isin("stage_start", "stage_end")).select(by, *order, "kind", "stage", F.col("ts").cast("double").alias("_t"))
    d = with_previous(range_chunks(e, by, list(order)), by, list(order), ["kind", "stage", "_t"])
    open_ = (F.col("prev_kind") == "stage_start") & ((F.col("kind") == "stage_start") | (F.col("stage") == F.col("prev_stage")))
    return d.filter(open_).groupBy(by, F.col("prev_stage").alias("stage")).agg(F.sum(F.col("_t") - F.col("prev__t")).alias("seconds"), F.count(F.lit(1)).alias("runs"))


def stage_profile(durations: DataFrame, sizes: DataFrame | None = None, by: str = "job_id") -> DataFrame:
    """Share of each stage in its job's total, rank by time, and surfels and faces per second."""
    total = durations.groupBy(by).agg(F.sum("seconds").alias("total_seconds"))
    d = attach(durations, total, by).withColumn("share_pct", F.col("seconds") / F.greatest(F.lit(1e-4), F.col("total_seconds")) * 100.0)
    d = d.withColumn("_neg", -F.col("seconds"))
    d = ranked(d, by, ["_neg", "stage"], "rank").drop("_neg")
    if sizes is not None:
        d = attach(d, sizes, by)
        rate = lambda c: F.when(F.col("total_seconds") > 0, F.col(c) / F.col("total_seconds"))
        d = d.withColumns({"surfels_per_s": rate("surfels"), "faces_per_s": rate("faces")})
    return d


def human_size(size: Column) -> Column:
    out = F.format_string("%.1f TB", size / 1024.0**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (k + 1), F.format_string("%.1f " + unit, size / 1024.0**k)).otherwise(out)
    return out


def artifact_audit(files: DataFrame, by: str = "job_id") -> DataFrame:
    """Expected files of each job: present or missing, with readable size (files: by, name, size)."""
    want = files.select(by).distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in EXPECTED_FILES])))
    have = files.filter(F.col("name").isin(EXPECTED_FILES)).groupBy(by, "name").agg(F.max("size").alias("size"))
    d = want.join(have, [by, "name"], "left")
    return d.withColumns({"present": F.col("size").isNotNull(), "size_text": human_size(F.col("size").cast("double"))})


def job_listing(jobs: DataFrame, priority: list[str]) -> DataFrame:
    """Jobs with a model, favourites first in their fixed order, then by name (adds position)."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("name"))
    d = jobs.filter("has_model").select("name").distinct().withColumn("_p", F.when(place > 0, place).otherwise(len(priority) + 1)).withColumn("_all", F.lit(0))
    return ranked(d, "_all", ["_p", "name"], "position").select("position", "name")


def job_hud(measurements: DataFrame, quality: DataFrame, durations: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Headline numbers of each job from its measurements, quality report and stage times; missing parts stay null."""
    t = durations.groupBy(by).agg(F.sum("seconds").alias("_total"))
    d = measurements.join(quality, by, "full").join(t, by, "left")
    return d.select(by, F.round("footprint_m2", 2).alias("footprint_m2"), F.round("volume_m3", 2).alias("volume_m3"), F.round("gsd", 4).alias("gsd"),
                    F.round("mean_gps_residual_m", 4).alias("gps_residual_m"), F.round("mean_reprojection_error", 2).alias("reprojection_px"),
                    F.round("support_ratio", 4).alias("support_ratio"), "quality_status", F.round("_total", 1).alias("total_seconds"))


def ablation_compare(runs: DataFrame, baseline: str, metrics: list[str], by: str = FLIGHT) -> DataFrame:
    """Each run's metrics next to those of the baseline run of the same flight, with the differences."""
    b = runs.filter(F.col("run") == baseline).select(by, *[F.col(m).alias("base_" + m) for m in metrics])
    d = attach(runs, b, by)
    return d.withColumns({"delta_" + m: F.col(m) - F.col("base_" + m) for m in metrics})


# --- missions --------------------------------------------------------------------------------------------------------

def mission_flight(points: DataFrame, by: str = FLIGHT) -> DataFrame:
    """Centre, height, point count and duration of a mission's path (by, rec_no, lat, lng, altitude)."""
    g = points.groupBy(by).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min_by("altitude", "rec_no").alias("altitude"), F.count(F.lit(1)).alias("points"))
    return g.withColumn("duration", F.col("points") * 1.5)


def mission_footprint(centres: DataFrame, by: str = FLIGHT, d_lat: float = 0.00045, d_lng: float = 0.00065) -> DataFrame:
    """Closed five-point ring about a mission's centre (array of [lng, lat])."""
    corner = lambda sx, sy: F.array(F.col("lng") + sx * d_lng, F.col("lat") + sy * d_lat)
    return centres.select(by, F.array(*[corner(*s) for s in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]).alias("ring"))


def mission_status(missions: DataFrame, mission_id: str | None = None) -> DataFrame:
    """Status, stage and progress of missions, or of one."""
    d = missions if mission_id is None else missions.filter(F.col("id") == mission_id)
    return d.select("id", "status", "stage", "progress", "error")


def mission_model(missions: DataFrame, model_id: str | None = None) -> DataFrame:
    """Model links of missions that are ready, or of the one with the given model."""
    d = missions.filter((F.col("status") == "ready") & F.col("model_id").isNotNull())
    d = d if model_id is None else d.filter(F.col("model_id") == model_id)
    return d.select("id", "model_id", "viewer_url", "model_url")
