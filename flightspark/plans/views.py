"""Flight tables derived from the driver's tables, in Spark and as SQL sub-selects with the same arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightspark.operators import timeseries as ts
from flightspark.plans.registry import cte
from flightspark.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


def derived(name: str):
    """Keeps a view that many queries share as one checkpointed table per application and data folder.

    The query that shows the view itself takes `.anew`, which reads no stored copy of it.
    """

    def wrap(build):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _DERIVED:
                _DERIVED[key] = checkpointed(build(spark, sf_dir))
            return _DERIVED[key]
        get.anew = build
        return get
    return wrap


def _micros() -> str:
    return "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"


# --- telemetry -----------------------------------------------------------------------------------------------------

def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(floor(event_id / 1000) AS BIGINT) AS flight_id", "event_id AS rec_no",
        f"CAST(floor({_micros()} / 6000) AS DOUBLE) AS raw_ts",
        "47.38D + ((event_id * 37) % 1000) * 1e-5D AS lat", "8.54D + ((event_id * 53) % 1000) * 1e-5D AS lon",
        "450D + value / 10 AS alt", "0D AS rel_alt", "CAST((event_id * 7) % 360 AS DOUBLE) AS yaw",
        "CAST(event_id % 60 AS DOUBLE) - 30 AS pitch", "CAST(event_id % 20 AS DOUBLE) - 10 AS roll",
        "greatest(0.1D, value / 50) AS unc", "greatest(0.1D, value / 50) * 1.6D AS vunc", "event_id + 1 AS image_id")


cte("v_telemetry", """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS flight_id, event_id AS rec_no,
  CAST(floor(epoch_us(ts) / 6000) AS DOUBLE) AS raw_ts,
  CAST(47.38 AS DOUBLE) + ((event_id * 37) % 1000) * CAST(1e-5 AS DOUBLE) AS lat,
  CAST(8.54 AS DOUBLE) + ((event_id * 53) % 1000) * CAST(1e-5 AS DOUBLE) AS lon,
  450 + value / 10 AS alt, CAST(0 AS DOUBLE) AS rel_alt, CAST((event_id * 7) % 360 AS DOUBLE) AS yaw,
  CAST(event_id % 60 AS DOUBLE) - 30 AS pitch, CAST(event_id % 20 AS DOUBLE) - 10 AS roll,
  greatest(CAST(0.1 AS DOUBLE), value / 50) AS unc, greatest(CAST(0.1 AS DOUBLE), value / 50) * CAST(1.6 AS DOUBLE) AS vunc,
  event_id + 1 AS image_id
FROM events""")


@derived("timed")
def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry in seconds (the unit is found by the operator)."""
    return ts.normalize_time_unit(telemetry(spark, sf_dir))


cte("t_step", """
SELECT flight_id, quantile_cont(d, 0.5) AS med FROM (
  SELECT flight_id, raw_ts - lag(raw_ts) OVER (PARTITION BY flight_id ORDER BY raw_ts) AS d FROM v_telemetry)
WHERE d IS NOT NULL GROUP BY flight_id""")
cte("t_div", """
SELECT flight_id, step, CASE WHEN n < 3 THEN 1.0 ELSE divisor END AS divisor FROM (
  SELECT e.flight_id, e.n, c.step, arg_min(k.div, CASE WHEN c.step / k.div < 1e-4 OR c.step / k.div > 30 THEN 12 ELSE 0 END
    + abs(ln(c.step / k.div / 0.03))) AS divisor
  FROM (SELECT flight_id, count(*) AS n, min(raw_ts) AS lo, max(raw_ts) AS hi FROM v_telemetry GROUP BY flight_id) e
  JOIN (SELECT s.flight_id, CASE WHEN s.med > 0 THEN s.med ELSE r.g END AS step FROM t_step s JOIN
    (SELECT flight_id, (max(raw_ts) - min(raw_ts)) / greatest(1, count(*) - 1) AS g FROM v_telemetry GROUP BY flight_id) r USING (flight_id)) c
  USING (flight_id), (VALUES (1e0), (1e3), (1e6), (1e9)) AS k(div)
  GROUP BY e.flight_id, e.n, c.step)""")
cte("v_timed", "SELECT t.*, t.raw_ts / d.divisor AS ts FROM v_telemetry t JOIN t_div d USING (flight_id)")


@derived("located")
def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed telemetry with its origin and local position."""
    return ts.attach_datum(timed(spark, sf_dir))


def ecef_sql(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    e2 = "((6378137.0::DOUBLE*6378137.0::DOUBLE - 6356752.314245::DOUBLE*6356752.314245::DOUBLE)/(6378137.0::DOUBLE*6378137.0::DOUBLE))"
    n = f"(6378137.0::DOUBLE/sqrt(1-{e2}*sin(radians({lat}))*sin(radians({lat}))))"
    return (f"(({n}+{alt})*cos(radians({lat}))*cos(radians({lon})))", f"(({n}+{alt})*cos(radians({lat}))*sin(radians({lon})))",
            f"(({n}*(1-{e2})+{alt})*sin(radians({lat})))")


_here, _ref = ecef_sql("lat", "lon", "alt"), ecef_sql("ref_lat", "ref_lon", "ref_alt")
cte("t_datum", "SELECT flight_id, arg_min(lat, rec_no) AS ref_lat, arg_min(lon, rec_no) AS ref_lon, arg_min(alt, rec_no) AS ref_alt FROM v_telemetry GROUP BY flight_id")
cte("t_ecef", f"""
SELECT t.*, d.ref_lat, d.ref_lon, d.ref_alt, {_here[0]} AS ecef_x, {_here[1]} AS ecef_y, {_here[2]} AS ecef_z,
  {_here[0]} - {_ref[0]} AS dx, {_here[1]} - {_ref[1]} AS dy, {_here[2]} - {_ref[2]} AS dz,
  radians(ref_lat) AS p, radians(ref_lon) AS l
FROM v_timed t JOIN t_datum d USING (flight_id)""")
cte("v_located", """
SELECT * EXCLUDE (dx, dy, dz, p, l), -sin(l)*dx + cos(l)*dy AS enu_x, -sin(p)*cos(l)*dx - sin(p)*sin(l)*dy + cos(p)*dz AS enu_y,
  cos(p)*cos(l)*dx + cos(p)*sin(l)*dy + sin(p)*dz AS enu_z
FROM t_ecef""")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pose per telemetry record: its local position, turned about the vertical by yaw."""
    return located(spark, sf_dir).selectExpr(
        "flight_id", "rec_no % 1000 AS frame_id", "ts", "enu_x AS tx", "enu_y AS ty", "enu_z AS tz",
        "cos(radians(yaw)) AS r00", "-sin(radians(yaw)) AS r01", "0D AS r02", "sin(radians(yaw)) AS r10",
        "cos(radians(yaw)) AS r11", "0D AS r12", "0D AS r20", "0D AS r21", "1D AS r22", "unc")


cte("v_poses", """
SELECT flight_id, rec_no % 1000 AS frame_id, ts, enu_x AS tx, enu_y AS ty, enu_z AS tz, radians(yaw) AS a,
  cos(radians(yaw)) AS c, sin(radians(yaw)) AS s, unc FROM v_located""")


# --- points, cameras, surfels ----------------------------------------------------------------------------------------

_POINT_COLS = """CAST(floor(l_orderkey / 1500) AS BIGINT) AS flight_id, (l_orderkey * 7 + l_linenumber) % 200 AS frame_id,
  (l_partkey % 20) * {f}0.08{e} + {f}0.01{e} + l_linenumber * {f}0.008{e} AS x,
  (l_orderkey % 13) * {f}0.08{e} + {f}0.02{e} + l_discount * {f}0.4{e} AS y,
  floor(l_quantity / 13) * {f}1.2{e} + {f}0.03{e} AS z, {f}1{e} - 5 * l_discount AS conf,
  CAST(CAST(l_extendedprice AS BIGINT) % 256 AS DOUBLE) AS r, CAST(CAST(l_extendedprice AS BIGINT) % 251 AS DOUBLE) AS g,
  CAST(CAST(l_extendedprice AS BIGINT) % 241 AS DOUBLE) AS b,
  CASE WHEN l_linenumber < 5 THEN {f}0{e} ELSE {f}1{e} END AS nx, {f}0{e} AS ny, CASE WHEN l_linenumber < 5 THEN {f}1{e} ELSE {f}0{e} END AS nz,
  l_tax AS tax"""


def point_columns(lineitem: DataFrame) -> DataFrame:
    exprs = _POINT_COLS.format(f="CAST(", e=" AS DOUBLE)").replace("CAST(l_extendedprice AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)")
    return lineitem.select(*[F.expr(e.strip()) for e in _split(exprs)])


def _split(columns: str) -> list[str]:
    """Cuts a select list at its top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out, cur = out + [cur], ""
        else:
            cur += ch
    return out + [cur]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_columns(table(spark, sf_dir, "lineitem"))


cte("v_points", "SELECT " + _POINT_COLS.format(f="CAST(", e=" AS DOUBLE)").replace(
    "CAST(l_extendedprice AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)") + " FROM lineitem")

CAMERA = {"fx": 300.0, "fy": 300.0, "cx": 320.0, "cy": 240.0, "width": 640, "height": 480,
          "k1": 0.05, "k2": -0.01, "p1": 0.001, "p2": -0.0005, "k3": 0.0}
_CAMS = """flight_id, frame_id, frame_id / {f}30{e} AS ts, {f}0.8{e} + ((frame_id * 7) % 40 - 20) * {f}0.05{e} AS tx,
  {f}0.5{e} + ((frame_id * 3) % 30 - 15) * {f}0.04{e} AS ty, {f}8{e} + (frame_id % 5) * {f}0.25{e} AS tz,
  cos(radians(frame_id * {f}1.8{e})) AS r00, sin(radians(frame_id * {f}1.8{e})) * cos(radians((frame_id % 7 - 3) * {f}4{e})) AS r01,
  -sin(radians(frame_id * {f}1.8{e})) * sin(radians((frame_id % 7 - 3) * {f}4{e})) AS r02, sin(radians(frame_id * {f}1.8{e})) AS r10,
  -cos(radians(frame_id * {f}1.8{e})) * cos(radians((frame_id % 7 - 3) * {f}4{e})) AS r11,
  cos(radians(frame_id * {f}1.8{e})) * sin(radians((frame_id % 7 - 3) * {f}4{e})) AS r12, {f}0{e} AS r20,
  -sin(radians((frame_id % 7 - 3) * {f}4{e})) AS r21, -cos(radians((frame_id % 7 - 3) * {f}4{e})) AS r22"""


@derived("cams")
def cams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One downward-looking pose per (flight, frame) that has points."""
    base = points(spark, sf_dir).select("flight_id", "frame_id").distinct()
    return base.select(*[F.expr(e.strip()) for e in _split(_CAMS.format(f="CAST(", e=" AS DOUBLE)"))])


cte("v_cam_frames", "SELECT DISTINCT flight_id, frame_id FROM v_points")
cte("v_cams", "SELECT " + _CAMS.format(f="CAST(", e=" AS DOUBLE)") + " FROM v_cam_frames")


def intrinsics(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lit(val) for k, val in CAMERA.items()})


@derived("surfels")
def surfels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surfel per 0.08 m cell of the points, with the frames that saw it."""
    p = points(spark, sf_dir).selectExpr("*", "CAST(floor(x / 0.08D) AS BIGINT) AS gx", "CAST(floor(y / 0.08D) AS BIGINT) AS gy",
                                         "CAST(floor(z / 0.08D) AS BIGINT) AS gz")
    s = p.groupBy("flight_id", "gx", "gy", "gz").agg(
        *[F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b", "conf")], F.avg("nx").alias("mx"), F.avg("nz").alias("mz"),
        F.max("conf").alias("model_confidence"), (F.avg("tax") * 50).alias("reprojection_error"),
        F.array_sort(F.collect_set("frame_id")).alias("supporting_frames"))
    return s.selectExpr(
        "flight_id", "((flight_id * 1000 + gx) * 1000 + gy) * 1000 + gz AS element_id", "gx", "gy", "gz", "x", "y", "z",
        "mx / sqrt(mx * mx + mz * mz) AS nx", "0D AS ny", "mz / sqrt(mx * mx + mz * mz) AS nz", "r", "g", "b",
        "supporting_frames", "size(supporting_frames) AS observation_count", "reprojection_error", "model_confidence",
        "0.5D + conf / 2 AS gps_confidence", "CASE WHEN (gx + gy) % 5 = 0 THEN 0.3D ELSE 0D END AS dynamic_probability",
        "conf AS confidence_score", "CASE WHEN (gx * 7 + gy * 3 + gz) % 17 = 0 THEN 'REJECTED' ELSE 'ACTIVE' END AS state",
        "CASE WHEN size(supporting_frames) > 1 THEN 'MULTI_VIEW_SUPPORTED' ELSE 'OBSERVED' END AS provenance",
        "CASE WHEN conf > 0.8003 THEN 'HIGH' WHEN conf > 0.7003 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level",
        "CASE (gx + gy * 2 + gz) % 5 WHEN 0 THEN 'vegetation' WHEN 1 THEN 'building' WHEN 2 THEN 'road' WHEN 3 THEN 'roof' ELSE 'unknown' END AS semantic_class")


cte("s_points", "SELECT *, CAST(floor(x / CAST(0.08 AS DOUBLE)) AS BIGINT) AS gx, CAST(floor(y / CAST(0.08 AS DOUBLE)) AS BIGINT) AS gy, CAST(floor(z / CAST(0.08 AS DOUBLE)) AS BIGINT) AS gz FROM v_points")
cte("s_cells", """
SELECT flight_id, gx, gy, gz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(conf) AS conf, avg(nx) AS mx, avg(nz) AS mz,
  max(conf) AS model_confidence, avg(tax) * 50 AS reprojection_error, count(DISTINCT frame_id) AS observation_count, min(frame_id) AS f0, max(frame_id) AS f1
FROM s_points GROUP BY flight_id, gx, gy, gz""")
cte("v_surfels", """
SELECT flight_id, ((flight_id * 1000 + gx) * 1000 + gy) * 1000 + gz AS element_id, gx, gy, gz, x, y, z, mx / sqrt(mx*mx + mz*mz) AS nx,
  CAST(0 AS DOUBLE) AS ny, mz / sqrt(mx*mx + mz*mz) AS nz, r, g, b, observation_count, reprojection_error, model_confidence,
  0.5 + conf / 2 AS gps_confidence, CASE WHEN (gx + gy) % 5 = 0 THEN 0.3 ELSE 0 END AS dynamic_probability, conf AS confidence_score,
  CASE WHEN (gx * 7 + gy * 3 + gz) % 17 = 0 THEN 'REJECTED' ELSE 'ACTIVE' END AS state,
  CASE WHEN observation_count > 1 THEN 'MULTI_VIEW_SUPPORTED' ELSE 'OBSERVED' END AS provenance,
  CASE WHEN conf > 0.8003 THEN 'HIGH' WHEN conf > 0.7003 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
  CASE (gx + gy * 2 + gz) % 5 WHEN 0 THEN 'vegetation' WHEN 1 THEN 'building' WHEN 2 THEN 'road' WHEN 3 THEN 'roof' ELSE 'unknown' END AS semantic_class, f0, f1
FROM s_cells""")
cte("v_surfel_frames", "SELECT DISTINCT flight_id, ((flight_id * 1000 + gx) * 1000 + gy) * 1000 + gz AS element_id, frame_id FROM s_points")


# --- tracks ----------------------------------------------------------------------------------------------------------

@derived("track_obs")
def track_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.expr("l_partkey % 8").alias("flight_id"), F.col("l_partkey").alias("track_id"), F.expr("(l_suppkey * 3 + l_linenumber) % 120").alias("frame_id")
    ).agg((F.avg("l_quantity") * 20).alias("u"), (F.avg("l_extendedprice") / 100).alias("v"))


cte("v_track_obs", """
SELECT l_partkey % 8 AS flight_id, l_partkey AS track_id, (l_suppkey * 3 + l_linenumber) % 120 AS frame_id, avg(l_quantity) * 20 AS u, avg(l_extendedprice) / 100 AS v
FROM lineitem GROUP BY 1, 2, 3""")


# --- pixels ----------------------------------------------------------------------------------------------------------

@derived("tiles")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 picture in four 4 x 4 tiles; flight = vec_id div 50, frame = vec_id % 50."""
    e = table(spark, sf_dir, "embeddings").withColumn("_t", F.explode(F.expr("sequence(0, 3)")))
    byte = "lpad(hex(CAST(floor(abs(CAST(element_at(embedding, CAST(((_t div 2) * 4 + i div 4) * 8 + (_t % 2) * 4 + i % 4 + 1 AS INT)) AS DOUBLE)) * {k}) % 256 AS BIGINT)), 2, '0')"
    rgb = "unhex(array_join(transform(sequence(0, 15), i -> concat(" + ", ".join(byte.format(k=k) for k in (1000, 1700, 2300)) + ")), ''))"
    return e.selectExpr("CAST(floor(vec_id / 50) AS BIGINT) AS flight_id", "vec_id % 50 AS frame_id", "CAST(_t % 2 AS INT) AS tile_u", "CAST(_t div 2 AS INT) AS tile_v",
                        "4 AS w", "4 AS h", f"{rgb} AS rgb")


cte("v_pixels", """
SELECT CAST(floor(vec_id / 50) AS BIGINT) AS flight_id, vec_id % 50 AS frame_id, CAST(i % 8 AS BIGINT) AS u, CAST(i // 8 AS BIGINT) AS v,
  CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1000) % 256 AS BIGINT) AS r, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1700) % 256 AS BIGINT) AS g,
  CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 2300) % 256 AS BIGINT) AS b
FROM embeddings, (SELECT unnest(range(64)) AS i)""")

# --- small-picture cameras: the same poses seen by a 32 x 24 pixel camera whose picture follows a formula --------------

PROXY = {"fx": 15.0, "fy": 15.0, "cx": 16.0, "cy": 12.0, "width": 32, "height": 24}
PROXY_TILE = 16
_PIXEL = {"r": "({frame} * 7 + {u} * 13 + {v} * 5) % 256", "g": "({frame} * 3 + {u} * 5 + {v} * 11) % 256", "b": "({u} * {v} + {frame}) % 256"}


def proxy_cams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cams(spark, sf_dir).withColumns({k: F.lit(val) for k, val in PROXY.items()})


def _draw(size: int):
    """Adds the pixels of tiles (frame_id, tile_u, tile_v, w, h) by the formulas of `_PIXEL`; a tile without a frame has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = []
            for frame, tu, tv, w, h in zip(*[batch.column(c).to_pylist() for c in ("frame_id", "tile_u", "tile_v", "w", "h")]):
                i = np.arange(w * h)
                u, v = tu * size + i % w, tv * size + i // w
                rgb.append(b"" if frame is None else np.stack([(frame * 7 + u * 13 + v * 5) % 256, (frame * 3 + u * 5 + v * 11) % 256, (u * v + frame) % 256], 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rgb, pa.binary())], names=[*batch.schema.names, "rgb"])

    return run


@derived("proxy_tiles")
def proxy_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-pixel tiles of the pictures of all poses. Poses are a small table, which is dealt out before pictures are made of it."""
    t = cams(spark, sf_dir).select("flight_id", "frame_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "flight_id", "frame_id")
    t = t.withColumn("_t", F.explode(F.expr("sequence(0, 3)")))
    t = t.selectExpr("flight_id", "frame_id", "CAST(_t % 2 AS INT) AS tile_u", "CAST(_t div 2 AS INT) AS tile_v", "16 AS w", "CAST(if(_t div 2 = 0, 16, 8) AS INT) AS h")
    return t.mapInArrow(_draw(PROXY_TILE), "flight_id long, frame_id long, tile_u int, tile_v int, w int, h int, rgb binary")


def pixel_sql(frame: str, u: str, v: str) -> str:
    """Grey level of the formula picture."""
    r, g, b = (e.format(frame=frame, u=u, v=v) for e in _PIXEL.values())
    return f"floor(CAST(0.299 AS DOUBLE) * ({r}) + CAST(0.587 AS DOUBLE) * ({g}) + CAST(0.114 AS DOUBLE) * ({b}) + 0.5)"
