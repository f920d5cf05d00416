"""Queries over quality, jobs, missions and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.operators import jobs as jb
from flightspark.plans import surfaces
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register
from flightspark.session import shared_folder
from flightspark.sources import missions as mi
from flightspark.sources import sinks as sk

# --- stage events: a user's events are its job's log -----------------------------------------------------------------------


def stage_events(spark, sf_dir):
    return v.table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id", f"{v._micros()} / 1000000D AS ts", "event_id AS seq",
        "CASE event_type WHEN 'error' THEN 'warning' WHEN 'signup' THEN 'stage_end' ELSE 'stage_start' END AS kind",
        "CASE event_type WHEN 'signup' THEN 'view' ELSE event_type END AS stage")


cte("j_events", """
SELECT user_id AS job_id, epoch_us(ts) / 1000000.0 AS ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'stage_end' ELSE 'stage_start' END AS kind, CASE event_type WHEN 'signup' THEN 'view' ELSE event_type END AS stage
FROM events WHERE event_type <> 'error'""")
cte("j_stage", """
SELECT job_id, ps AS stage, sum(ts - pt) AS seconds, count(*) AS runs FROM (SELECT *, lag(kind) OVER w AS pk, lag(stage) OVER w AS ps, lag(ts) OVER w AS pt FROM j_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq))
WHERE pk = 'stage_start' AND (kind = 'stage_start' OR stage = ps) GROUP BY 1, 2""")


@register("stage_durations", "job_id:i stage:s seconds:3 runs:i", "SELECT * FROM j_stage")
def _durations(spark, sf_dir):
    return jb.stage_durations(stage_events(spark, sf_dir))


@register("stage_profile", "job_id:i stage:s seconds:3 total_seconds:3 share_pct:4 rank:i surfels_per_s:6 faces_per_s:6", """
SELECT *, seconds / greatest(1e-4, total_seconds) * 100 AS share_pct, row_number() OVER (PARTITION BY job_id ORDER BY seconds DESC, stage) - 1 AS rank, job_id * 1000 / total_seconds AS surfels_per_s, job_id * 77 / total_seconds AS faces_per_s
FROM (SELECT *, sum(seconds) OVER (PARTITION BY job_id) AS total_seconds FROM j_stage)""")
def _profile(spark, sf_dir):
    d = jb.stage_durations(stage_events(spark, sf_dir))
    return jb.stage_profile(d, d.selectExpr("job_id", "job_id * 1000 AS surfels", "job_id * 77 AS faces").distinct())


_FILES = ["model.glb", "model.ply", "world.json", "notes.txt", "report.json", "quality.json", "texture.png"]
_NAMED = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FILES)) + " END"
_EXPECTED = ", ".join(f"('{n}')" for n in jb.EXPECTED_FILES)


@register("artifact_audit", "job_id:i name:s present:b size_text:s", f"""
WITH f AS (SELECT user_id AS job_id, {_NAMED} AS name, CAST(floor(value * value * value * 50) AS BIGINT) AS size FROM events)
SELECT j.job_id, e.n AS name, s AS size, s IS NOT NULL AS present, CASE WHEN s < 1024 THEN format('{{:.1f}} B', s / 1.0) WHEN s < 1048576 THEN format('{{:.1f}} KB', s / 1024.0) WHEN s < 1073741824 THEN format('{{:.1f}} MB', s / 1048576.0) WHEN s IS NOT NULL THEN format('{{:.1f}} GB', s / 1073741824.0) END AS size_text
FROM (SELECT DISTINCT job_id FROM f) j CROSS JOIN (VALUES {_EXPECTED}) e(n) LEFT JOIN (SELECT job_id, name, max(size) AS s FROM f GROUP BY 1, 2) x ON x.job_id = j.job_id AND x.name = e.n""")
def _audit(spark, sf_dir):
    files = v.table(spark, sf_dir, "events").selectExpr("user_id AS job_id", f"{_NAMED} AS name", "CAST(floor(value * value * value * 50) AS BIGINT) AS size")
    return jb.artifact_audit(files).withColumn("size_text", F.when(F.col("present"), F.col("size_text")))


@register("job_listing", "position:i name:s", """
SELECT row_number() OVER (ORDER BY CASE c_name WHEN 'Customer#000000007' THEN 1 WHEN 'Customer#000000003' THEN 2 ELSE 3 END, c_name) - 1 AS position, c_name AS name FROM customer WHERE c_acctbal > 0""")
def _listing(spark, sf_dir):
    jobs = v.table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal > 0 AS has_model")
    return jb.job_listing(jobs, ["Customer#000000007", "Customer#000000003"])


# --- quality ---------------------------------------------------------------------------------------------------------------------

cte("j_mesh", """
SELECT m.flight_id, faces, degenerate, non_manifold FROM (SELECT flight_id, count(*) AS faces, sum(CASE WHEN area < 1e-10 THEN 1 ELSE 0 END) AS degenerate FROM v_metric GROUP BY 1) m
JOIN (SELECT flight_id, sum(CASE WHEN uses > 2 THEN 1 ELSE 0 END) AS non_manifold FROM v_edges GROUP BY 1) e USING (flight_id)""")
cte("j_qa", """
SELECT *, CASE WHEN residual <= 2.5 AND support_ratio >= 0.325 AND mean_reprojection_error <= 4.5 AND faces >= 200 AND degenerate = 0 AND non_manifold = 0 AND coverage >= 0.75 THEN 'PASSED' ELSE 'FLAGGED' END AS quality_status FROM (
SELECT s.flight_id, avg(CASE WHEN reprojection_error > 0 THEN reprojection_error END) AS mean_reprojection_error, sum(CASE WHEN provenance IN ('OBSERVED', 'MULTI_VIEW_SUPPORTED') THEN 1 ELSE 0 END) / count(*) AS support_ratio,
  100.0 * sum(CASE WHEN provenance = 'OBSERVED' THEN 1 ELSE 0 END) / count(*) AS observed_percent, 100.0 * sum(CASE WHEN provenance = 'MULTI_VIEW_SUPPORTED' THEN 1 ELSE 0 END) / count(*) AS multi_view_percent, count(*) AS elements,
  any_value(0.7 + (s.flight_id % 4) * 0.1) AS coverage FROM v_surfels s GROUP BY 1) JOIN j_mesh USING (flight_id) JOIN (SELECT flight_id, avg(abs(unc) * 3) AS residual FROM v_telemetry GROUP BY 1) USING (flight_id)""")


def _quality(spark, sf_dir):
    res = v.telemetry(spark, sf_dir).selectExpr("flight_id", "abs(unc) * 3 AS residual_m")
    from flightspark.operators import mesh as ms
    m = surfaces.metrics(spark, sf_dir).groupBy("flight_id").agg(F.count(F.lit(1)).alias("faces"), F.sum(F.when(F.col("area") < 1e-10, 1).otherwise(0)).alias("degenerate"))
    m = m.join(ms.edge_topology(surfaces.faces(spark, sf_dir)).select("flight_id", "non_manifold"), "flight_id")
    tex = m.selectExpr("flight_id", "0.7D + (flight_id % 4) * 0.1D AS coverage")
    return jb.qa_gates(res, v.surfels(spark, sf_dir), m, tex)


@register("qa_gates", "flight_id:i mean_gps_residual_m:5 mean_reprojection_error:4 support_ratio:5 observed_percent:4 multi_view_percent:4 elements:i faces:i quality_status:s",
          "SELECT *, residual AS mean_gps_residual_m FROM j_qa")
def _qa(spark, sf_dir):
    return _quality(spark, sf_dir)


@register("job_hud", "flight_id:i footprint_m2:2 gsd:4 reprojection_px:2 support_ratio:4 quality_status:s total_seconds:1", """
SELECT q.flight_id, n * gsd_x * gsd_y AS footprint_m2, (gsd_x + gsd_y) / 2 AS gsd, mean_reprojection_error AS reprojection_px, support_ratio, quality_status, t AS total_seconds FROM j_qa q JOIN r_grid g USING (flight_id)
JOIN (SELECT flight_id, count(*) AS n FROM r_dsm GROUP BY 1) d USING (flight_id) LEFT JOIN (SELECT job_id AS flight_id, sum(seconds) AS t FROM j_stage GROUP BY 1) s USING (flight_id)""")
def _hud(spark, sf_dir):
    from flightspark.operators import raster as ra
    m = ra.measurements(surfaces.dsm(spark, sf_dir), surfaces.grid(spark, sf_dir), surfaces.vertices(spark, sf_dir))
    d = jb.stage_durations(stage_events(spark, sf_dir)).withColumnRenamed("job_id", "flight_id")
    return jb.job_hud(m, _quality(spark, sf_dir), d)


@register("ablation_compare", "flight_id:i run:s surfels:i error:4 delta_surfels:i delta_error:4", """
WITH r AS (SELECT flight_id, provenance AS run, count(*) AS surfels, avg(reprojection_error) AS error FROM v_surfels GROUP BY 1, 2)
SELECT r.*, r.surfels - b.surfels AS delta_surfels, r.error - b.error AS delta_error FROM r LEFT JOIN r b ON b.flight_id = r.flight_id AND b.run = 'MULTI_VIEW_SUPPORTED'""")
def _ablation(spark, sf_dir):
    runs = v.surfels(spark, sf_dir).groupBy("flight_id", F.col("provenance").alias("run")).agg(F.count(F.lit(1)).alias("surfels"), F.avg("reprojection_error").alias("error"))
    return jb.ablation_compare(runs, "MULTI_VIEW_SUPPORTED", ["surfels", "error"])


# --- missions --------------------------------------------------------------------------------------------------------------------

def _path_points(spark, sf_dir):
    return v.telemetry(spark, sf_dir).selectExpr("flight_id", "rec_no", "lat", "lon AS lng", "alt AS altitude")


@register("mission_flight", "flight_id:i lat:7 lng:7 altitude:3 points:i duration:1",
          "SELECT flight_id, avg(lat) AS lat, avg(lon) AS lng, arg_min(alt, rec_no) AS altitude, count(*) AS points, count(*) * 1.5 AS duration FROM v_telemetry GROUP BY 1")
def _flight(spark, sf_dir):
    return jb.mission_flight(_path_points(spark, sf_dir))


@register("mission_footprint", "flight_id:i lng0:6 lat0:6 lng2:6 lat2:6 n:i", """
SELECT flight_id, avg(lon) - 0.00065 AS lng0, avg(lat) - 0.00045 AS lat0, avg(lon) + 0.00065 AS lng2, avg(lat) + 0.00045 AS lat2, 5 AS n FROM v_telemetry GROUP BY 1""")
def _mission_footprint(spark, sf_dir):
    d = jb.mission_footprint(jb.mission_flight(_path_points(spark, sf_dir)))
    r = F.col("ring")
    return d.select("flight_id", r[0][0].alias("lng0"), r[0][1].alias("lat0"), r[2][0].alias("lng2"), r[2][1].alias("lat2"), F.size("ring").alias("n"))


_STATUS = "CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'uploaded' WHEN 'purchase' THEN 'reconstructing' WHEN 'signup' THEN 'created' ELSE 'failed' END"


def mission_docs(spark, sf_dir):
    """A JSON document per event; every thirteenth one is cut off."""
    e = v.table(spark, sf_dir, "events").withColumn("st", F.expr(_STATUS))
    doc = F.to_json(F.struct(F.concat(F.lit("mission_"), F.col("event_id")).alias("id"), F.col("st").alias("status"), F.struct(
        F.col("event_type").alias("stage"), F.col("value").alias("progress")).alias("processing"), F.struct(
        F.when(F.col("st") == "ready", F.concat(F.lit("model_"), F.col("event_id"))).alias("modelId"), F.lit("/v").alias("viewerUrl"), F.lit("/m").alias("modelUrl")).alias("reconstruction")))
    return e.select(F.when(F.col("event_id") % 13 == 0, F.substring(doc, 1, 9)).otherwise(doc).alias("value"))


cte("j_missions", f"""
SELECT 'mission_' || event_id AS id, {_STATUS} AS status, event_type AS stage, value AS progress, CASE WHEN {_STATUS} = 'ready' THEN 'model_' || event_id END AS model_id FROM events WHERE event_id % 13 <> 0""")


@register("read_missions", "id:s status:s stage:s progress:3 model_id:s", "SELECT * FROM j_missions")
def _read_missions(spark, sf_dir):
    return mi.parse_missions(mission_docs(spark, sf_dir))


@register("mission_status", "id:s status:s stage:s progress:3", "SELECT * FROM j_missions")
def _mission_status(spark, sf_dir):
    return jb.mission_status(mi.parse_missions(mission_docs(spark, sf_dir)))


@register("mission_model", "id:s model_id:s viewer_url:s model_url:s", "SELECT id, model_id, '/v' AS viewer_url, '/m' AS model_url FROM j_missions WHERE status = 'ready'")
def _mission_model(spark, sf_dir):
    return jb.mission_model(mi.parse_missions(mission_docs(spark, sf_dir)))


# --- sinks -----------------------------------------------------------------------------------------------------------------------

@register("write_world", "flight_id:i element_id:i x:5 semantic_class:s", "SELECT flight_id, element_id, x, semantic_class FROM v_surfels WHERE state <> 'REJECTED'")
def _world(spark, sf_dir):
    folder = shared_folder(spark, "files")
    sk.write_world(v.surfels(spark, sf_dir), folder)
    return spark.read.parquet(folder)


@register("write_uncertainty", "flight_id:i element_id:i confidence_score:5 confidence_level:s covariance_trace:6",
          "SELECT flight_id, element_id, confidence_score, confidence_level, 0.03 * observation_count AS covariance_trace FROM v_surfels WHERE state <> 'REJECTED'")
def _uncertainty(spark, sf_dir):
    cov = F.array(*[F.when(F.lit(k % 4 == 0), F.col("observation_count") * 0.01).otherwise(F.lit(0.0)) for k in range(9)])
    folder = shared_folder(spark, "files")
    sk.write_uncertainty(v.surfels(spark, sf_dir).withColumn("cov", cov), folder)
    return spark.read.parquet(folder)


@register("write_overlay", "flight_id:i provenance:s confidence_level:s n:i", "SELECT flight_id, provenance, confidence_level, count(*) AS n FROM v_surfels WHERE state <> 'REJECTED' GROUP BY 1, 2, 3")
def _overlay(spark, sf_dir):
    folder = shared_folder(spark, "files")
    sk.write_overlay(v.surfels(spark, sf_dir), folder)
    return spark.read.schema("provenance string, confidence_level string, n long, flight_id long").json(folder)


@register("write_poses", "flight_id:i frame_id:i t0:4 r00:5 r22:3", "SELECT flight_id, frame_id, tx AS t0, r00, r22 FROM v_cams")
def _poses(spark, sf_dir):
    folder = shared_folder(spark, "files")
    sk.write_poses(v.cams(spark, sf_dir), folder)
    d = spark.read.text(folder)
    g = lambda p: F.get_json_object("value", p).cast("double")
    return d.select("flight_id", g("$.frame_id").alias("frame_id"), g("$.t_wc[0]").alias("t0"), g("$.R_wc[0][0]").alias("r00"), (g("$.R_wc[2][2]") + 0.0).alias("r22"))


_PLY = ["ply", "format ascii 1.0", *[f"property float {c}" for c in ("x", "y", "z", "nx", "ny", "nz")], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]


@register("write_point_cloud", "flight_id:i part:s value:s", f"""
SELECT flight_id, 'vertices' AS part, format('{{:.4f}} {{:.4f}} {{:.4f}} {{:.4f}} {{:.4f}} {{:.4f}} {{:d}} {{:d}} {{:d}}', x, y, z, nx, ny, nz, CAST(r AS INT), CAST(g AS INT), CAST(b AS INT)) AS value FROM v_points
UNION ALL SELECT flight_id, 'header', unnest(list_concat({_PLY!r}, ['element vertex ' || n])) FROM (SELECT flight_id, count(*) AS n FROM v_points GROUP BY 1)""")
def _cloud(spark, sf_dir):
    folder = shared_folder(spark, "files")
    sk.write_point_cloud(v.points(spark, sf_dir), folder, normals=True)
    return spark.read.text(folder)


@register("splat_table", "flight_id:i element_id:i f_dc_0:5 scale:6 opacity:1 qw:5 qx:5 qy:5", """
SELECT flight_id, element_id, (r/255 - 0.5) / 0.28209479177387814 AS f_dc_0, ln(0.8 * 0.08) AS scale, CASE WHEN confidence_score > 0.6 THEN 4 ELSE 2 END AS opacity, sqrt((1 + nz) / 2) AS qw, 0 AS qx, nx / sqrt(2 * (1 + nz)) AS qy FROM v_surfels WHERE state <> 'REJECTED'""")
def _splat(spark, sf_dir):
    return sk.splat_table(v.surfels(spark, sf_dir), 0.08)


def _geojson(spark, lines):
    """The lines of a written collection."""
    folder = shared_folder(spark, "files")
    sk.write_geojson(lines, folder)
    return spark.read.text(folder)


@register("flight_path_geojson", "flight_id:i value:s", """
WITH t AS (SELECT flight_id, format('[{:.7f},{:.7f},{:.2f}]', lon, lat, alt + 0.0013) AS p, row_number() OVER (PARTITION BY flight_id ORDER BY rec_no) AS k, count(*) OVER (PARTITION BY flight_id) AS n FROM v_telemetry)
SELECT flight_id, CASE WHEN k < n THEN p || ',' ELSE p END AS value FROM t
UNION ALL SELECT DISTINCT flight_id, unnest(['{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[', ']}}]}']) FROM t""")
def _path_geojson(spark, sf_dir):
    return _geojson(spark, sk.flight_path_geojson(v.telemetry(spark, sf_dir).withColumn("alt", F.col("alt") + 0.0013)))


@register("footprints_geojson", "flight_id:i lines:i kind:s height_m:2 lng0:5 lat0:5 n:i", """
SELECT b.flight_id, 3 AS lines, 'FeatureCollection' AS kind, round(hm, 2) AS height_m, 8.54 + x0 / 75517.0 AS lng0, 47.38 + y0 / 111170.0 AS lat0, 5 AS n FROM (
SELECT s.flight_id, min(x) AS x0, min(y) AS y0, max(z) - any_value(zg) AS hm FROM v_surfels s JOIN (SELECT flight_id, quantile_cont(z, 0.12) AS zg FROM v_surfels GROUP BY 1) g ON g.flight_id = s.flight_id WHERE z > zg + 2.5 GROUP BY 1 HAVING count(*) >= 30) b""")
def _footprints(spark, sf_dir):
    from flightspark.operators import raster as ra
    fp = ra.building_footprint(v.surfels(spark, sf_dir))
    d = sk.footprints_geojson(fp, fp.select("flight_id", F.lit(47.38).alias("ref_lat"), F.lit(8.54).alias("ref_lon"), F.lit(450.0).alias("ref_alt")))
    # A flight has one footprint, so its three lines are put together and read as one document.
    part = lambda p: F.max(F.when(F.col("value").rlike(p), F.col("value")))
    lines = _geojson(spark, sk.feature_collection(d)).groupBy("flight_id").agg(F.count(F.lit(1)).alias("lines"), F.concat(part("Collection"), part('"Feature"'), part("^\\]")).alias("doc"))
    g = lambda p: F.get_json_object("doc", p)
    return lines.select("flight_id", "lines", g("$.type").alias("kind"), g("$.features[0].properties.height_m").cast("double").alias("height_m"),
                        g("$.features[0].geometry.coordinates[0][0][0]").cast("double").alias("lng0"), g("$.features[0].geometry.coordinates[0][0][1]").cast("double").alias("lat0"), F.size(F.split("doc", r"\],\[")).alias("n"))
