"""Queries over text telemetry and telemetry time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.functions import geodesy, rotation as R
from flightspark.operators import timeseries as ts
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register
from flightspark.session import shared_folder
from flightspark.sources import telemetry as src

# --- text sources: telemetry is written out as text, then read back by the parser ------------------------------------

_CLOCK = "concat(lpad(CAST(floor({s}/3600000) AS STRING), 2, '0'), ':', lpad(CAST(floor({s}/60000) % 60 AS STRING), 2, '0'), ':', lpad(CAST(floor({s}/1000) % 60 AS STRING), 2, '0'), ',', lpad(CAST({s} % 1000 AS STRING), 3, '0'))"


def _srt_text(spark, sf_dir):
    """Two subtitle lines per record; every seventh record names its height `altitude`, every eleventh lies at 0, 0."""
    clock = _CLOCK.format(s="(rec_no * 33 % 86400000)")
    return v.telemetry(spark, sf_dir).withColumn("zero", F.col("rec_no") % 11 == 0).selectExpr(
        "flight_id", "rec_no", f"""concat(CAST(rec_no AS STRING), '\n', {clock}, ' --> ', {clock}, '\n', '[iso: 100] ',
        format_string('[latitude: %.6f] [longitude: %.6f] [rel_alt: %.3f] [%s: %.3f] [yaw: %.1f] [pitch: %.1f] [roll: %.1f]',
        if(zero, 0D, lat), if(zero, 0D, lon), alt - 400, if(rec_no % 7 = 0, 'altitude', 'abs_alt'), alt, yaw, pitch, roll)) AS block""")


cte("t_srt", """
SELECT flight_id, rec_no, (rec_no * 33 % 86400000) / 1000.0 AS ts, CASE WHEN rec_no % 11 = 0 THEN 0 ELSE round(lat, 6) END AS lat,
  CASE WHEN rec_no % 11 = 0 THEN 0 ELSE round(lon, 6) END AS lon, round(alt, 3) AS alt, round(alt - 400, 3) AS rel_alt, yaw, pitch, roll
FROM v_telemetry""")


@register("read_srt", "flight_id:i rec_no:i ts:3 lat:6 lon:6 alt:3 rel_alt:3 yaw:1 pitch:1 roll:1 unc:3",
          "SELECT *, 1.0 AS unc FROM t_srt WHERE rec_no % 11 <> 0")
def _read_srt(spark, sf_dir):
    return src.parse_srt(_srt_text(spark, sf_dir), "flight_id")


@register("read_srt_ui", "flight_id:i timestamp:3 lat:6 lng:6 alt:3 yaw:1 pitch:1 roll:1", """
SELECT flight_id, CASE WHEN ts > 0 THEN ts ELSE (row_number() OVER (PARTITION BY flight_id ORDER BY rec_no) - 1) * 0.05 END AS timestamp,
  lat, lon AS lng, rel_alt AS alt, yaw, pitch, roll FROM t_srt WHERE rec_no % 11 <> 0""")
def _read_srt_ui(spark, sf_dir):
    lines = _srt_text(spark, sf_dir).select("flight_id", "rec_no", F.posexplode(F.split("block", "\n")).alias("p", "value"))
    return src.parse_srt_ui(lines.withColumn("rec_no", F.col("rec_no") * 4 + F.col("p")).drop("p"), "flight_id")


@register("read_srt_path", "flight_id:i rec_no:i lat:6 lng:6 altitude:3",
          "SELECT flight_id, rec_no, lat, lon AS lng, rel_alt AS altitude FROM t_srt")
def _read_srt_path(spark, sf_dir):
    return src.parse_srt_path(_srt_text(spark, sf_dir), "flight_id")


def _csv_rows(spark, sf_dir):
    """Logger rows as text: micro-degree coordinates, an implausible vertical error now and then, empty cells."""
    return v.telemetry(spark, sf_dir).selectExpr(
        "flight_id", "rec_no", "CAST(raw_ts AS STRING) AS Timpstemp", "CAST(image_id AS STRING) AS imgid",
        "CAST(CAST(round(lat * 10000000) AS BIGINT) AS STRING) AS lat", "CAST(CAST(round(lon * 10000000) AS BIGINT) AS STRING) AS lon",
        "format_string('%.2f', alt) AS alt", "format_string('%.4f', unc) AS eph_m",
        "CASE WHEN rec_no % 5 = 0 THEN '1e-20' WHEN rec_no % 5 = 1 THEN '' ELSE '2.5' END AS epv_m",
        "CASE WHEN rec_no % 3 = 0 THEN '' WHEN rec_no % 97 = 1 THEN 'bad' ELSE CAST(yaw AS STRING) END AS heading")


@register("read_telemetry_csv", "flight_id:i rec_no:i ts:6 lat:6 lon:6 alt:2 yaw:1 unc:4 vunc:5 image_id:i", """
SELECT flight_id, rec_no, ts, round(lat * 10000000) / 1e7 AS lat, round(lon * 10000000) / 1e7 AS lon, round(alt, 2) AS alt,
  CASE WHEN rec_no % 3 = 0 THEN 0 ELSE yaw END AS yaw, greatest(0.1, round(unc, 4)) AS unc,
  CASE WHEN rec_no % 5 >= 2 THEN 2.5 ELSE greatest(0.1, round(unc, 4)) * 1.6 END AS vunc, image_id
FROM v_timed WHERE rec_no % 97 <> 1 OR rec_no % 3 = 0""")
def _read_csv(spark, sf_dir):
    return src.parse_telemetry_rows(_csv_rows(spark, sf_dir), "flight_id")


def _files(lines):
    """Text lines (flight_id, k, value) written as one file per flight; the folder of them."""
    folder = shared_folder(lines.sparkSession, "files")
    lines.repartition("flight_id").sortWithinPartitions("flight_id", "k").select("flight_id", "value").write.partitionBy("flight_id").text(folder)
    return folder


def _flight_of(df):
    return df.withColumn("flight_id", F.regexp_extract("path", r"flight_id=(\d+)", 1).cast("long"))


@register("read_srt_files", "flight_id:i ts:3 lat:6 lon:6 alt:3 rel_alt:3 yaw:1 pitch:1 roll:1 unc:3", "SELECT *, 1.0 AS unc FROM t_srt WHERE rec_no % 11 <> 0")
def _read_srt_files(spark, sf_dir):
    # Every third flight has plain line ends, the others carriage returns or blank lines of spaces and tabs.
    text = _srt_text(spark, sf_dir).withColumn("value", F.expr("""CASE flight_id % 3 WHEN 0 THEN concat(block, '\n')
        WHEN 1 THEN concat(replace(block, '\n', '\r\n'), '\r\n\r') ELSE concat(block, '\n \t') END"""))
    return _flight_of(src.read_srt(spark, _files(text.withColumn("k", F.col("rec_no")))))


@register("read_telemetry_csv_files", "flight_id:i ts:6 lat:6 lon:6 alt:2 yaw:1 unc:4 vunc:5 image_id:i", """
SELECT flight_id, ts, round(lat * 10000000) / 1e7 AS lat, round(lon * 10000000) / 1e7 AS lon, round(alt, 2) AS alt,
  CASE WHEN rec_no % 3 = 0 OR flight_id % 4 = 3 THEN 0 ELSE yaw END AS yaw, greatest(0.1, round(unc, 4)) AS unc,
  CASE WHEN rec_no % 5 >= 2 THEN 2.5 ELSE greatest(0.1, round(unc, 4)) * 1.6 END AS vunc, image_id
FROM v_timed WHERE rec_no % 97 <> 1 OR rec_no % 3 = 0 OR flight_id % 4 = 3""")
def _read_csv_files(spark, sf_dir):
    # Logs of three makes in one folder: names, order and number of columns differ, one has quotes, one has no heading.
    rows = _csv_rows(spark, sf_dir)
    makes = F.expr("flight_id % 4")
    line = (F.when(makes == 3, F.concat_ws(",", "lat", "lon", "alt", "eph_m", "epv_m", "imgid", "Timpstemp"))
            .when(makes == 1, F.concat_ws(" , ", F.concat(F.lit('"'), "imgid", F.lit('"')), "heading", "Timpstemp", "lon", "lat", F.lit('"a, b"'), "alt", "eph_m", "epv_m"))
            .otherwise(F.concat_ws(",", "Timpstemp", "imgid", "lat", "lon", "alt", "eph_m", "epv_m", "heading")))
    head = (F.when(makes == 3, "Latitude,Longitude,HEIGHT,Accuracy,Vertical_Accuracy,img_id,t")
            .when(makes == 1, ' frame , yaw,Time,lng,LAT,"note, free",abs_alt,uncertainty,epv_m').otherwise("Timpstemp,imgid,lat,lon,alt,eph_m,epv_m,heading"))
    lines = rows.select("flight_id", F.col("rec_no").alias("k"), line.alias("value"))
    heads = rows.select("flight_id").distinct().select("flight_id", F.lit(-1).cast("long").alias("k"), head.alias("value"))
    return _flight_of(src.read_telemetry_csv(spark, _files(heads.unionByName(lines))))


@register("read_telemetry_json", "doc:i rec_no:i ts:3 lat:6 lon:6 alt:3 unc:4", """
SELECT flight_id * 1000 + rec_no % 1000 // 10 AS doc, rec_no % 10 AS rec_no, raw_ts AS ts, lat, lon, alt,
  CASE WHEN rec_no % 2 = 0 THEN unc ELSE 1 END AS unc FROM v_telemetry""")
def _read_json(spark, sf_dir):
    t = v.telemetry(spark, sf_dir).withColumn("doc", F.expr("flight_id * 1000 + (rec_no % 1000) div 10"))
    full = F.struct(F.col("raw_ts").alias("timestamp"), F.col("lat"), F.col("lon"), F.col("alt"),
                    F.when(F.col("rec_no") % 2 == 0, F.col("unc")).alias("uncertainty"))
    docs = t.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rec_no", full.alias("p")))).alias("a"))
    body = F.to_json(F.transform("a", lambda s: s["p"]))
    value = F.when(F.col("doc") % 3 == 0, body).when(F.col("doc") % 3 == 1, F.concat(F.lit('{"records":'), body, F.lit("}"))).otherwise(
        F.concat(F.lit('{"telemetry":'), body, F.lit("}")))
    return src.parse_telemetry_json(docs.select("doc", value.alias("value")), "doc")


def _baro_rows(spark, sf_dir):
    return v.telemetry(spark, sf_dir).selectExpr(
        "flight_id", "rec_no", "CAST(raw_ts + 13 AS STRING) AS Timpstemp", "'96000' AS Pressure",
        "CASE WHEN rec_no % 101 = 5 THEN 'nan' ELSE CAST(455 + (rec_no * 11 % 100) / 100 AS STRING) END AS Altitude")


cte("v_baro", "SELECT flight_id, rec_no, raw_ts + 13 AS raw_ts, 455 + (rec_no * 11 % 100) / 100 AS alt FROM v_telemetry WHERE rec_no % 101 <> 5")


@register("read_baro", "flight_id:i rec_no:i raw_ts:1 alt:3 n_rows:i usable:b", """
SELECT *, count(*) OVER (PARTITION BY flight_id) AS n_rows, count(*) OVER (PARTITION BY flight_id) >= 8 AS usable FROM v_baro""")
def _read_baro(spark, sf_dir):
    return src.parse_baro_rows(_baro_rows(spark, sf_dir), "flight_id")


def _truth_rows(spark, sf_dir):
    return v.telemetry(spark, sf_dir).selectExpr(
        "flight_id", "if(rec_no % 13 = 3, 'x', CAST(rec_no AS STRING)) AS imgid", "CAST(rec_no * 3 % 101 AS STRING) AS x_gt",
        "CAST(rec_no * 5 % 103 AS STRING) AS y_gt", "CAST(alt AS STRING) AS z_gt", "CAST(yaw AS STRING) AS omega_gt",
        "CAST(pitch AS STRING) AS phi_gt", "CAST(roll AS STRING) AS kappa_gt", "' 1.5' AS x_gps", "'2.5 ' AS y_gps", "'' AS z_gps")


cte("v_truth", """
SELECT flight_id, rec_no AS imgid, rec_no * 3 % 101 AS x_gt, rec_no * 5 % 103 AS y_gt, alt AS z_gt, yaw AS omega_gt, pitch AS phi_gt,
  roll AS kappa_gt, 1.5 AS x_gps, 2.5 AS y_gps, CAST(NULL AS DOUBLE) AS z_gps FROM v_telemetry WHERE rec_no % 13 <> 3""")


@register("read_ground_truth", "flight_id:i imgid:i x_gt:3 y_gt:3 z_gt:3 omega_gt:3 phi_gt:3 kappa_gt:3 x_gps:3 y_gps:3 z_gps:3",
          "SELECT * FROM v_truth")
def _read_truth(spark, sf_dir):
    return src.parse_ground_truth(_truth_rows(spark, sf_dir), "flight_id")


@register("read_streetview", "flight_id:i lat:6 lon:6 yaw:3 tilt_yaw:3 tilt_pitch:3 aux:3",
          "SELECT flight_id, lat, lon, yaw, pitch AS tilt_yaw, roll AS tilt_pitch, rec_no AS aux FROM v_telemetry")
def _read_streetview(spark, sf_dir):
    rows = v.telemetry(spark, sf_dir).selectExpr(
        "flight_id", "concat(' ', lat) AS lat", "concat(' ', lon) AS lon", "CAST(yaw AS STRING) AS yaw", "CAST(pitch AS STRING) AS tilt_yaw",
        "CAST(roll AS STRING) AS tilt_pitch", "CAST(rec_no AS STRING) AS aux")
    return src.parse_streetview(rows, "flight_id")


# --- time series -----------------------------------------------------------------------------------------------------

@register("normalize_time_unit", "flight_id:i rec_no:i ts:6 divisor:1",
          "SELECT flight_id, rec_no, ts, divisor FROM v_timed JOIN t_div USING (flight_id)")
def _normalize(spark, sf_dir):
    t = v.telemetry(spark, sf_dir)
    return ts.normalize_time_unit(t).withColumn("divisor", F.col("raw_ts") / F.col("ts"))


@register("geodetic_to_ecef", "rec_no:i x:2 y:2 z:2", "SELECT rec_no, ecef_x AS x, ecef_y AS y, ecef_z AS z FROM v_located")
def _to_ecef(spark, sf_dir):
    x, y, z = geodesy.geodetic_to_ecef("lat", "lon", "alt")
    return v.telemetry(spark, sf_dir).select("rec_no", x.alias("x"), y.alias("y"), z.alias("z"))


@register("ecef_to_enu", "rec_no:i e:3 n:3 u:3", "SELECT rec_no, enu_x AS e, enu_y AS n, enu_z AS u FROM v_located")
def _to_enu(spark, sf_dir):
    t = ts.attach(v.telemetry(spark, sf_dir), ts.datum(v.telemetry(spark, sf_dir)), "flight_id")
    e, n, u = geodesy.ecef_to_enu(*geodesy.geodetic_to_ecef("lat", "lon", "alt"), "ref_lat", "ref_lon", "ref_alt")
    return t.select("rec_no", e.alias("e"), n.alias("n"), u.alias("u"))


@register("enu_to_ecef", "rec_no:i x:2 y:2 z:2", "SELECT rec_no, ecef_x AS x, ecef_y AS y, ecef_z AS z FROM v_located")
def _enu_to_ecef(spark, sf_dir):
    x, y, z = geodesy.enu_to_ecef("enu_x", "enu_y", "enu_z", "ref_lat", "ref_lon", "ref_alt")
    return v.located(spark, sf_dir).select("rec_no", x.alias("x"), y.alias("y"), z.alias("z"))


@register("ecef_to_geodetic", "rec_no:i lat:7 lon:7 alt:3", "SELECT rec_no, lat, lon, alt FROM v_telemetry")
def _to_geodetic(spark, sf_dir):
    lat, lon, alt = geodesy.ecef_to_geodetic(*geodesy.geodetic_to_ecef("lat", "lon", "alt"))
    return v.telemetry(spark, sf_dir).select("rec_no", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))


@register("enu_to_geodetic", "rec_no:i lat:7 lon:7 alt:3", "SELECT rec_no, lat, lon, alt FROM v_telemetry")
def _enu_to_geodetic(spark, sf_dir):
    lat, lon, alt = geodesy.enu_to_geodetic("enu_x", "enu_y", "enu_z", "ref_lat", "ref_lon", "ref_alt")
    return v.located(spark, sf_dir).select("rec_no", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))


@register("attach_datum", "rec_no:i ref_lat:6 ref_lon:6 ref_alt:3 enu_x:3 enu_y:3 enu_z:3",
          "SELECT rec_no, ref_lat, ref_lon, ref_alt, enu_x, enu_y, enu_z FROM v_located")
def _attach_datum(spark, sf_dir):
    return v.located.anew(spark, sf_dir)


cte("v_moving", """
SELECT *, CASE WHEN pt IS NULL THEN 0 ELSE ex / dt END AS vx, CASE WHEN pt IS NULL THEN 0 ELSE ey / dt END AS vy,
  CASE WHEN pt IS NULL THEN 0 ELSE ez / dt END AS vz,
  CASE WHEN pt IS NOT NULL AND ex*ex + ey*ey > 0.01 THEN degrees(atan2(ex, ey)) ELSE 0 END AS heading
FROM (SELECT *, lag(ts) OVER w AS pt, greatest(1e-4, ts - lag(ts) OVER w) AS dt, enu_x - lag(enu_x) OVER w AS ex, enu_y - lag(enu_y) OVER w AS ey,
  enu_z - lag(enu_z) OVER w AS ez FROM v_located WINDOW w AS (PARTITION BY flight_id ORDER BY rec_no))""")


@register("velocity_heading", "rec_no:i vx:1 vy:1 vz:1 heading:4", "SELECT rec_no, vx, vy, vz, heading FROM v_moving")
def _velocity(spark, sf_dir):
    return ts.velocity_heading(v.located(spark, sf_dir))


@register("path_length", "flight_id:i distance_m:3 records:i ref_lat:6",
          "SELECT flight_id, coalesce(sum(sqrt(ex*ex + ey*ey + ez*ez)), 0) AS distance_m, count(*) AS records, min(ref_lat) AS ref_lat FROM v_moving GROUP BY flight_id")
def _path_length(spark, sf_dir):
    return ts.path_length(v.located(spark, sf_dir))


@register("image_index", "flight_id:i image_id:i rec_no:i ts:6 lat:6", """
SELECT flight_id, img AS image_id, arg_max(rec_no, struct_pack(ts, rec_no)) AS rec_no, max(ts) AS ts, arg_max(lat, struct_pack(ts, rec_no)) AS lat
FROM (SELECT *, image_id % 300 AS img FROM v_timed) WHERE img > 0 GROUP BY flight_id, img""")
def _image_index(spark, sf_dir):
    return ts.image_index(v.timed(spark, sf_dir).withColumn("image_id", F.col("image_id") % 300))


def _video(spark, sf_dir):
    """Video frames: one per record, half a step after it; every fifth sits on a record, the ends lie outside."""
    return v.timed(spark, sf_dir).selectExpr(
        "flight_id", "rec_no % 1000 AS frame_id", "CASE WHEN rec_no % 1000 = 0 THEN ts - 5 WHEN rec_no % 1000 = 999 THEN ts + 5 "
        "WHEN rec_no % 5 = 0 THEN ts ELSE ts + 0.004 END AS ts")


cte("v_video", """
SELECT flight_id, rec_no % 1000 AS frame_id, CASE WHEN rec_no % 1000 = 0 THEN ts - 5 WHEN rec_no % 1000 = 999 THEN ts + 5
  WHEN rec_no % 5 = 0 THEN ts ELSE ts + 0.004 END AS ts FROM v_timed""")
cte("v_bracket", """
SELECT q.flight_id, q.frame_id, q.ts AS q_ts, coalesce(a.rec_no, b.rec_no) AS r0, coalesce(b.rec_no, a.rec_no) AS r1, coalesce(f.ts <= q.ts, false) AS at_end, f.rec_no AS rl
FROM v_video q
JOIN (SELECT flight_id, max(ts) AS ts, arg_max(rec_no, struct_pack(ts, rec_no)) AS rec_no FROM v_timed GROUP BY flight_id) f USING (flight_id)
ASOF LEFT JOIN v_timed a ON a.flight_id = q.flight_id AND a.ts < q.ts
ASOF LEFT JOIN v_timed b ON b.flight_id = q.flight_id AND b.ts >= q.ts""")
cte("v_pair", """
SELECT k.flight_id, k.frame_id, k.q_ts, a.*, CASE WHEN a.ts0 = b.ts1 THEN 0 ELSE (k.q_ts - a.ts0) / greatest(1e-6, b.ts1 - a.ts0) END AS al, b.*
FROM v_bracket k
JOIN (SELECT rec_no AS i0, ts AS ts0, enu_x AS x0, enu_y AS y0, enu_z AS z0, yaw AS w0, unc AS u0, lat AS lat0 FROM v_located) a ON a.i0 = CASE WHEN k.at_end THEN k.rl ELSE k.r0 END
JOIN (SELECT rec_no AS i1, ts AS ts1, enu_x AS x1, enu_y AS y1, enu_z AS z1, yaw AS w1, unc AS u1, lat AS lat1 FROM v_located) b ON b.i1 = CASE WHEN k.at_end THEN k.rl ELSE k.r1 END""")
cte("v_asof", """
SELECT flight_id, frame_id, q_ts, (1-al)*x0 + al*x1 AS enu_x, (1-al)*y0 + al*y1 AS enu_y, (1-al)*z0 + al*z1 AS enu_z, (1-al)*w0 + al*w1 AS yaw,
  greatest(u0, u1) AS unc, (1-al)*lat0 + al*lat1 AS lat FROM v_pair""")


def _asof(spark, sf_dir):
    q = _video(spark, sf_dir).withColumnsRenamed({"frame_id": "q_id", "ts": "q_ts"})
    return ts.interp_asof(q, v.located(spark, sf_dir)).withColumnRenamed("q_id", "frame_id")


@register("interp_asof", "flight_id:i frame_id:i q_ts:6 enu_x:3 enu_y:3 enu_z:3 yaw:4 unc:4 lat:7", "SELECT * FROM v_asof")
def _interp_asof(spark, sf_dir):
    return _asof(spark, sf_dir)


# Only rotations about the vertical occur in the table, so the shorter arc between two yaws is the great circle.
_TURN = "(((degrees(q1 - q0) + 540) % 360) - 180)"


@register("interp_pose", "flight_id:i q_id:i tx:3 ty:3 r00:5 r10:5 r22:5", """
SELECT flight_id, frame_id AS q_id, CASE WHEN q_ts >= ts1 THEN x1 ELSE (1-al)*x0 + al*x1 END AS tx, CASE WHEN q_ts >= ts1 THEN y1 ELSE (1-al)*y0 + al*y1 END AS ty,
  cos(a) AS r00, sin(a) AS r10, 1 AS r22 FROM (SELECT *, CASE WHEN q_ts >= ts1 THEN radians(w1) ELSE
  radians(w0) + al * radians(((w1 - w0 + 540) % 360) - 180) END AS a FROM v_pair)""")
def _interp_pose(spark, sf_dir):
    q = _video(spark, sf_dir).withColumnsRenamed({"frame_id": "q_id", "ts": "q_ts"})
    return ts.interp_pose(q, v.poses(spark, sf_dir))


@register("baro_fuse", "flight_id:i rec_no:i enu_z:3 vunc:4 baro_used:b", """
WITH b0 AS (SELECT flight_id, rec_no, raw_ts, alt, row_number() OVER (PARTITION BY flight_id ORDER BY raw_ts, rec_no) - 1 AS k FROM v_baro),
bs AS (SELECT flight_id, quantile_cont(d, 0.5) AS step FROM (SELECT flight_id, raw_ts - lag(raw_ts) OVER (PARTITION BY flight_id ORDER BY raw_ts) AS d FROM v_baro) WHERE d IS NOT NULL GROUP BY 1),
bd AS (SELECT flight_id, arg_min(div, CASE WHEN step/div < 1e-4 OR step/div > 30 THEN 12 ELSE 0 END + abs(ln(step/div/0.03))) AS div FROM bs, (VALUES (1e0), (1e3), (1e6), (1e9)) AS k(div) GROUP BY 1),
b1 AS (SELECT flight_id, k, raw_ts / div AS t, alt FROM b0 JOIN bd USING (flight_id)),
bp AS (SELECT flight_id, count(*) AS n, arg_min(alt, k) AS a0, arg_max(alt, k) AS a1, min(t) AS t0, max(t) AS t1,
  (CAST(least(199, greatest(1, round_even(count(*) / greatest(1, max(t) - min(t)), 0))) AS INT) | 1) AS win FROM b1 GROUP BY 1),
b2 AS (SELECT x.flight_id, x.k, x.t, (sum(y.alt) + greatest(0, (win-1)//2 - x.k) * a0 + greatest(0, x.k + (win-1)//2 - (n-1)) * a1) / win AS alt
  FROM b1 x JOIN bp USING (flight_id) JOIN b1 y ON y.flight_id = x.flight_id AND y.k BETWEEN x.k - (win-1)//2 AND x.k + (win-1)//2 GROUP BY x.flight_id, x.k, x.t, win, a0, a1, n),
tt AS (SELECT flight_id, min(ts) AS s0, max(ts) AS s1 FROM v_located GROUP BY 1),
us AS (SELECT bp.flight_id FROM bp JOIN tt USING (flight_id) WHERE n >= 8 AND least(t1, s1) - greatest(t0, s0) >= 0.5 * (s1 - s0)),
br AS (SELECT q.flight_id, q.rec_no, q.ts, q.enu_z, q.vunc, a.t AS ta, a.alt AS za, b.t AS tb, b.alt AS zb FROM v_located q
  ASOF LEFT JOIN b2 a ON a.flight_id = q.flight_id AND a.t < q.ts ASOF LEFT JOIN b2 b ON b.flight_id = q.flight_id AND b.t >= q.ts),
sm AS (SELECT *, CASE WHEN ta IS NULL THEN zb WHEN tb IS NULL THEN za ELSE za + (zb - za) * (ts - ta) / greatest(1e-6, tb - ta) END AS z FROM br),
ofs AS (SELECT flight_id, quantile_cont(enu_z - z, 0.5) AS off FROM sm GROUP BY 1)
SELECT sm.flight_id, rec_no, CASE WHEN us.flight_id IS NULL THEN enu_z ELSE z + off END AS enu_z, CASE WHEN us.flight_id IS NULL THEN vunc ELSE 0.35 END AS vunc,
  us.flight_id IS NOT NULL AS baro_used FROM sm JOIN ofs USING (flight_id) LEFT JOIN us ON us.flight_id = sm.flight_id""")
def _baro_fuse(spark, sf_dir):
    b = src.parse_baro_rows(_baro_rows(spark, sf_dir), "flight_id").select("flight_id", "rec_no", "raw_ts", "alt")
    return ts.baro_fuse(v.located(spark, sf_dir), b)


@register("bind_by_image_id", "flight_id:i frame_id:i image_id:i ts:6 matched:i bound:b", """
WITH f AS (SELECT flight_id, rec_no % 1000 AS frame_id, CASE WHEN flight_id % 3 = 2 AND rec_no % 2 = 0 THEN 900000000 + rec_no ELSE rec_no + 1 END AS image_id, rec_no % 1000 / 30 AS ts0 FROM v_timed),
j AS (SELECT f.*, t.ts AS rt FROM f LEFT JOIN v_timed t ON t.flight_id = f.flight_id AND t.image_id = f.image_id),
m AS (SELECT flight_id, count(rt) AS matched, count(rt) >= greatest(3, floor(count(*) * 0.6)) AS bound FROM j GROUP BY 1)
SELECT j.flight_id, frame_id, image_id, CASE WHEN bound AND rt IS NOT NULL THEN rt ELSE ts0 END AS ts, matched, bound FROM j JOIN m USING (flight_id)""")
def _bind(spark, sf_dir):
    frames = v.telemetry(spark, sf_dir).selectExpr(
        "flight_id", "rec_no % 1000 AS frame_id", "(rec_no % 1000) / 30 AS ts",
        "concat('/data/flight_7/img2_', CASE WHEN flight_id % 3 = 2 AND rec_no % 2 = 0 THEN 900000000 + rec_no ELSE rec_no + 1 END, '.jpg') AS path")
    return ts.bind_by_image_id(frames, v.timed(spark, sf_dir))


@register("time_offset", "flight_id:i log_start:6 video_start:6 offset_s:6", """
SELECT flight_id, log_start, video_start, log_start - video_start AS offset_s FROM (SELECT flight_id, min(ts) AS log_start FROM v_timed GROUP BY 1)
JOIN (SELECT flight_id, arg_min(ts, frame_id) AS video_start FROM v_video GROUP BY 1) USING (flight_id)""")
def _time_offset(spark, sf_dir):
    return ts.time_offset(_video(spark, sf_dir), v.timed(spark, sf_dir))


@register("rot_to_quat", "flight_id:i frame_id:i qw:5 qz:5", """
SELECT flight_id, frame_id, abs(cos(a/2)) AS qw, abs(sin(a/2)) AS qz FROM v_poses""")
def _rot_to_quat(spark, sf_dir):
    return R.with_quat(v.poses(spark, sf_dir)).select("flight_id", "frame_id", F.abs("qw").alias("qw"), F.abs("qz").alias("qz"))


_RPY = {"cy": "cos(radians(yaw))", "sy": "sin(radians(yaw))", "cp": "cos(radians(pitch))", "sp": "sin(radians(pitch))",
        "cr": "cos(radians(roll))", "sr": "sin(radians(roll))"}
_BODY_SQL = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _RPY.items()) + " FROM v_asof_rpy"
cte("v_asof_rpy", "SELECT flight_id, rec_no % 1000 AS frame_id, enu_x, enu_y, enu_z, yaw, pitch, roll, unc, rec_no FROM v_located")
cte("v_attitude", f"""
SELECT flight_id, frame_id, cy*sp*sr - sy*cr AS r00, -(cy*sp*cr + sy*sr) AS r01, cy*cp AS r02, sy*sp*sr + cy*cr AS r10, -(sy*sp*cr - cy*sr) AS r11,
  sy*cp AS r12, cp*sr AS r20, -cp*cr AS r21, -sp AS r22, enu_x AS tx, enu_y AS ty, enu_z AS tz, 1 / greatest(0.1, unc) AS gps_w, rec_no FROM ({_BODY_SQL})""")


@register("quat_to_rot", "flight_id:i frame_id:i r00:5 r01:5 r02:5 r10:5 r11:5 r12:5 r20:5 r21:5 r22:5", """
SELECT flight_id, frame_id, r02 AS r00, r00 AS r01, -r01 AS r02, r12 AS r10, r10 AS r11, -r11 AS r12, r22 AS r20, r20 AS r21, -r21 AS r22 FROM v_attitude""")
def _quat_to_rot(spark, sf_dir):
    t = R.with_quat(v.located(spark, sf_dir).withColumn("frame_id", F.col("rec_no") % 1000), R.euler("yaw", "pitch", "roll"))
    back = R.quat_to_rot([F.col(n) for n in R.Q_NAMES])
    return t.select("flight_id", "frame_id", *[c.alias(n) for c, n in zip(back, R.R_NAMES)])


@register("pose_from_telemetry", "flight_id:i frame_id:i r00:6 r01:6 r02:6 r10:6 r11:6 r12:6 r20:6 r21:6 r22:6 tx:3 ty:3 tz:3 gps_w:5", """
SELECT flight_id, frame_id, CASE WHEN k THEN r00 ELSE 1 END AS r00, CASE WHEN k THEN r01 ELSE 0 END AS r01, CASE WHEN k THEN r02 ELSE 0 END AS r02,
  CASE WHEN k THEN r10 ELSE 0 END AS r10, CASE WHEN k THEN r11 ELSE 0 END AS r11, CASE WHEN k THEN r12 ELSE -1 END AS r12, CASE WHEN k THEN r20 ELSE 0 END AS r20,
  CASE WHEN k THEN r21 ELSE 1 END AS r21, CASE WHEN k THEN r22 ELSE 0 END AS r22, CASE WHEN k THEN tx ELSE frame_id * 0.5 END AS tx, CASE WHEN k THEN ty ELSE 0 END AS ty,
  CASE WHEN k THEN tz ELSE 10 END AS tz, CASE WHEN k THEN gps_w ELSE 0 END AS gps_w FROM (SELECT *, rec_no % 17 <> 4 AS k FROM v_attitude)""")
def _pose_from_telemetry(spark, sf_dir):
    gap = F.col("rec_no") % 17 == 4
    t = v.located(spark, sf_dir).withColumn("frame_id", F.col("rec_no") % 1000).withColumn("idx", F.col("frame_id"))
    return ts.pose_from_telemetry(t.withColumn("enu_x", F.when(~gap, F.col("enu_x"))))


@register("fill_missing_poses", "flight_id:i frame_id:i tx:3 ty:3 tz:3 r00:4 r10:4 cov:2 registered:b", """
WITH reg AS (SELECT * FROM v_poses WHERE frame_id % 7 NOT IN (0, 6)),
k AS (SELECT q.flight_id, q.frame_id, a.frame_id AS fa, b.frame_id AS fb FROM v_poses q
  ASOF LEFT JOIN reg a ON a.flight_id = q.flight_id AND a.frame_id <= q.frame_id ASOF LEFT JOIN reg b ON b.flight_id = q.flight_id AND b.frame_id >= q.frame_id),
m AS (SELECT k.flight_id, k.frame_id, fa, fb, coalesce(fa, fb) AS ka, coalesce(fb, fa) AS kb FROM k)
SELECT m.flight_id, m.frame_id, (1-al)*p.tx + al*q.tx AS tx, (1-al)*p.ty + al*q.ty AS ty, (1-al)*p.tz + al*q.tz AS tz,
  cos(p.a + al * radians(((degrees(q.a - p.a) + 540) % 360) - 180)) AS r00, sin(p.a + al * radians(((degrees(q.a - p.a) + 540) % 360) - 180)) AS r10,
  CASE WHEN fa = m.frame_id THEN NULL WHEN fa IS NULL OR fb IS NULL THEN 0.5 ELSE 0.25 END AS cov, coalesce(fa = m.frame_id, false) AS registered
FROM (SELECT *, CASE WHEN kb > ka THEN (frame_id - ka) / (kb - ka) ELSE 0 END AS al FROM m) m
JOIN reg p ON p.flight_id = m.flight_id AND p.frame_id = ka JOIN reg q ON q.flight_id = m.flight_id AND q.frame_id = kb""")
def _fill_missing(spark, sf_dir):
    p = v.poses(spark, sf_dir)
    return ts.fill_missing_poses(p.select("flight_id", "frame_id"), p.filter(~(F.col("frame_id") % 7).isin(0, 6)))


@register("gps_residual", "flight_id:i frame_id:i residual_m:3", """
SELECT flight_id, frame_id, sqrt((x.enu_x - p.tx)*(x.enu_x - p.tx) + (x.enu_y - p.ty)*(x.enu_y - p.ty) + (x.enu_z - p.tz)*(x.enu_z - p.tz)) AS residual_m
FROM v_asof x JOIN v_poses p USING (flight_id, frame_id)""")
def _gps_residual(spark, sf_dir):
    frames = _video(spark, sf_dir).withColumnRenamed("ts", "vts")
    p = v.poses(spark, sf_dir).join(frames, ["flight_id", "frame_id"]).drop("ts").withColumnRenamed("vts", "ts")
    return ts.gps_residual(p, v.located(spark, sf_dir))


@register("trajectory_residuals", "flight_id:i frame_id:i factor:s axis:s residual:1 weight:4", """
WITH p AS (SELECT *, 1 / greatest(0.1, unc) AS w, tx + 0.25 AS gx, ty - 0.5 AS gy, tz + 1 AS gz, ((degrees(a) + 540.5) % 360 - 180) * pi() / 180 AS wz FROM v_poses),
n AS (SELECT *, greatest(1e-3, ts - lag(ts) OVER o) AS d1, greatest(1e-3, lead(ts) OVER o - ts) AS d2, lag(tx) OVER o AS lx, lead(tx) OVER o AS nx,
  lag(ty) OVER o AS ly, lead(ty) OVER o AS ny, lag(tz) OVER o AS lz, lead(tz) OVER o AS nz, lag(wz) OVER o AS lw, lead(wz) OVER o AS nw
  FROM p WINDOW o AS (PARTITION BY flight_id ORDER BY frame_id)),
r AS (SELECT flight_id, frame_id, 'gps' AS factor, 'x' AS axis, (tx - gx) * 10 * w AS residual FROM p UNION ALL SELECT flight_id, frame_id, 'gps', 'y', (ty - gy) * 10 * w FROM p
  UNION ALL SELECT flight_id, frame_id, 'gps', 'z', (tz - gz) * 10 * w FROM p
  UNION ALL SELECT flight_id, frame_id, 'acceleration', 'x', ((nx - tx)/d2 - (tx - lx)/d1) * 2 FROM n UNION ALL SELECT flight_id, frame_id, 'acceleration', 'y', ((ny - ty)/d2 - (ty - ly)/d1) * 2 FROM n
  UNION ALL SELECT flight_id, frame_id, 'acceleration', 'z', ((nz - tz)/d2 - (tz - lz)/d1) * 2 FROM n
  UNION ALL SELECT flight_id, frame_id, 'rotation', 'x', CASE WHEN lw + nw IS NULL THEN NULL ELSE 0 END FROM n UNION ALL SELECT flight_id, frame_id, 'rotation', 'y', CASE WHEN lw + nw IS NULL THEN NULL ELSE 0 END FROM n
  UNION ALL SELECT flight_id, frame_id, 'rotation', 'z', nw - 2 * wz + lw FROM n)
SELECT *, CASE WHEN abs(residual) <= 2 THEN 1 ELSE 2 / abs(residual) END AS weight FROM r WHERE residual IS NOT NULL""")
def _trajectory_residuals(spark, sf_dir):
    turned = {"r00": "cos(radians(yaw + 0.5D))", "r01": "-sin(radians(yaw + 0.5D))", "r10": "sin(radians(yaw + 0.5D))", "r11": "cos(radians(yaw + 0.5D))"}
    yaw = v.telemetry(spark, sf_dir).selectExpr("flight_id", "rec_no % 1000 AS frame_id", "yaw")
    p = v.poses(spark, sf_dir).join(yaw, ["flight_id", "frame_id"]).withColumns({k: F.expr(e) for k, e in turned.items()}).withColumns({
        "gps_x": F.col("tx") + 0.25, "gps_y": F.col("ty") - 0.5, "gps_z": F.col("tz") + 1, "gps_w": 1 / F.greatest(F.lit(0.1), F.col("unc"))})
    return ts.trajectory_residuals(p)


@register("scale_agreement", "flight_id:i gps_m:3 truth_m:3 difference_m:3", """
WITH t AS (SELECT flight_id, rec_no, enu_x, enu_y, enu_z, row_number() OVER (PARTITION BY flight_id ORDER BY rec_no) AS k FROM v_located),
g AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY imgid) AS k FROM v_truth),
a AS (SELECT flight_id, sqrt((arg_max(enu_x,k)-arg_min(enu_x,k))**2 + (arg_max(enu_y,k)-arg_min(enu_y,k))**2 + (arg_max(enu_z,k)-arg_min(enu_z,k))**2) AS gps_m FROM t GROUP BY 1),
b AS (SELECT flight_id, sqrt((arg_max(x_gt,k)-arg_min(x_gt,k))**2 + (arg_max(y_gt,k)-arg_min(y_gt,k))**2 + (arg_max(z_gt,k)-arg_min(z_gt,k))**2) AS truth_m FROM g GROUP BY 1)
SELECT flight_id, gps_m, truth_m, abs(gps_m - truth_m) AS difference_m FROM a JOIN b USING (flight_id)""")
def _scale_agreement(spark, sf_dir):
    return ts.scale_agreement(v.located(spark, sf_dir), src.parse_ground_truth(_truth_rows(spark, sf_dir), "flight_id"))


@register("route_summary", "flight_id:i points:i lat_min:6 lat_max:6 lon_min:6 lon_max:6 lat_centre:7 lon_centre:7 lat_span:6 lon_span:6 aspect:5 duration_s:3 mean_alt:5", """
SELECT *, (lat_min + lat_max) / 2 AS lat_centre, (lon_min + lon_max) / 2 AS lon_centre, lat_max - lat_min AS lat_span, lon_max - lon_min AS lon_span,
  (lon_max - lon_min) / CASE WHEN lat_max = lat_min THEN 0.0001 ELSE lat_max - lat_min END AS aspect
FROM (SELECT flight_id, count(*) AS points, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
  arg_max(ts, rec_no) - arg_min(ts, rec_no) AS duration_s, avg(alt) AS mean_alt FROM t_srt WHERE rec_no % 11 <> 0 GROUP BY flight_id)""")
def _route_summary(spark, sf_dir):
    return ts.route_summary(src.parse_srt(_srt_text(spark, sf_dir), "flight_id"))


@register("active_segment", "flight_id:i frame:i lat:6 lon:6 captured_pct:i coverage_pct:i", """
SELECT flight_id, frame, lat, lon, floor(k / (n - 1) * 100 + 0.5) AS captured_pct, least(100, floor(floor(k / (n - 1) * 100 + 0.5) * 0.95 + 0.5)) AS coverage_pct
FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY rec_no) - 1 AS frame, count(*) OVER (PARTITION BY flight_id) AS n,
  least((flight_id * 37) % 1000, count(*) OVER (PARTITION BY flight_id) - 1) AS k FROM v_telemetry) WHERE frame <= k""")
def _active_segment(spark, sf_dir):
    return ts.active_segment(v.telemetry(spark, sf_dir), (F.col("flight_id") * 37) % 1000)
