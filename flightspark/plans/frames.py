"""Queries over cameras, frames and frame pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.functions import rotation as R
from flightspark.operators import camera as cam
from flightspark.operators import frames as fr
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register

# --- cameras: one per supplier -----------------------------------------------------------------------------------------


def _cameras(spark, sf_dir):
    return v.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS flight_id", "CAST(640 + s_suppkey * 8 AS INT) AS width", "CAST(480 + s_suppkey * 6 AS INT) AS height",
        "CASE WHEN s_suppkey % 3 = 0 THEN 500D + s_suppkey ELSE 0D END AS known_focal", "0.02D * (s_suppkey % 5) - 0.04D AS k1",
        "0.01D AS k2", "0.001D AS p1", "-0.001D AS p2", "0D AS k3")


cte("v_camera", """
SELECT *, CASE WHEN known_focal > 0 THEN known_focal ELSE width / 2 / tan(radians(80) / 2) END AS fx, width / 2 AS cx, height / 2 AS cy FROM (
SELECT s_suppkey AS flight_id, 640 + s_suppkey * 8 AS width, 480 + s_suppkey * 6 AS height, CASE WHEN s_suppkey % 3 = 0 THEN CAST(500 + s_suppkey AS DOUBLE) ELSE 0 END AS known_focal,
  CAST(0.02 AS DOUBLE) * (s_suppkey % 5) - CAST(0.04 AS DOUBLE) AS k1, CAST(0.01 AS DOUBLE) AS k2, CAST(0.001 AS DOUBLE) AS p1, CAST(-0.001 AS DOUBLE) AS p2 FROM supplier)""")


@register("camera_default", "flight_id:i fx:5 fy:5 cx:3 cy:3", "SELECT *, fx AS fy FROM v_camera")
def _camera_default(spark, sf_dir):
    return cam.camera_default(_cameras(spark, sf_dir))


@register("scale_intrinsics", "flight_id:i fx:5 fy:5 cx:3 cy:3 width:i",
          "SELECT flight_id, fx * 320 / width AS fx, fx * 200 / height AS fy, cx * 320 / width AS cx, cy * 200 / height AS cy, 320 AS width FROM v_camera")
def _scale_intrinsics(spark, sf_dir):
    return cam.scale_intrinsics(cam.camera_default(_cameras(spark, sf_dir)), F.lit(320), F.lit(200))


@register("focal_error", "flight_id:i default_fx:5 error_pct:5", """
SELECT flight_id, d AS default_fx, abs(d - fx) / fx * 100 AS error_pct FROM (SELECT *, width / 2 / tan(radians(80) / 2) AS d FROM v_camera)""")
def _focal_error(spark, sf_dir):
    return cam.focal_error(cam.camera_default(_cameras(spark, sf_dir)))


_DISTORT = """{x} * (1 + k1*r2 + k2*r2*r2) + 2*p1*{x}*{y} + p2*(r2 + 2*{x}*{x}) AS xd, {y} * (1 + k1*r2 + k2*r2*r2) + p1*(r2 + 2*{y}*{y}) + 2*p2*{x}*{y} AS yd"""


@register("rectified_coverage", "flight_id:i coverage:6", f"""
SELECT flight_id, avg(CASE WHEN fx*xd + cx BETWEEN 0 AND width - 1 AND fx*yd + cy BETWEEN 0 AND height - 1 THEN 1.0 ELSE 0.0 END) AS coverage FROM (
SELECT *, {_DISTORT.format(x='x', y='y')} FROM (SELECT *, x*x + y*y AS r2 FROM (
SELECT *, (gu * (width - 1) / 95 - cx) / (fx * 0.98) AS x, (gv * (height - 1) / 53 - cy) / (fx * 0.98) AS y FROM v_camera, (SELECT unnest(range(96)) AS gu), (SELECT unnest(range(54)) AS gv))))
GROUP BY flight_id""")
def _rectified(spark, sf_dir):
    d = cam.camera_default(_cameras(spark, sf_dir))
    return cam.rectified_coverage(d.withColumns({"nfx": F.col("fx") * 0.98, "nfy": F.col("fy") * 0.98, "ncx": F.col("cx"), "ncy": F.col("cy")}))


cte("p_cam", """
SELECT p.*, r00*(x-tx) + r10*(y-ty) + r20*(z-tz) AS xc, r01*(x-tx) + r11*(y-ty) + r21*(z-tz) AS yc, r02*(x-tx) + r12*(y-ty) + r22*(z-tz) AS zc
FROM v_points p JOIN v_cams USING (flight_id, frame_id)""")
cte("p_pix", f"""
SELECT *, 300*xd + 320 AS u, 300*yd + 240 AS v FROM (SELECT *, {_DISTORT.format(x='xn', y='yn')} FROM (
SELECT *, xn*xn + yn*yn AS r2, 0.05 AS k1, -0.01 AS k2, 0.001 AS p1, -0.0005 AS p2 FROM (SELECT *, CASE WHEN zc > 1e-4 THEN xc/zc END AS xn, CASE WHEN zc > 1e-4 THEN yc/zc END AS yn FROM p_cam)))""")


def _in_camera(spark, sf_dir):
    return v.intrinsics(cam.world_to_camera(v.points(spark, sf_dir), v.cams(spark, sf_dir)))


@register("distort", "flight_id:i frame_id:i xd:6 yd:6", "SELECT flight_id, frame_id, xd, yd FROM p_pix")
def _distort(spark, sf_dir):
    d = _in_camera(spark, sf_dir).withColumns({"xn": F.col("xc") / F.col("zc"), "yn": F.col("yc") / F.col("zc")})
    from flightspark.functions.camera import distort
    xd, yd = distort(F.col("xn"), F.col("yn"), *[F.col(k) for k in ("k1", "k2", "p1", "p2", "k3")])
    return d.withColumns({"xd": xd, "yd": yd})


@register("world_to_camera", "flight_id:i frame_id:i xc:6 yc:6 zc:6", "SELECT flight_id, frame_id, xc, yc, zc FROM p_cam")
def _world_to_camera(spark, sf_dir):
    return _in_camera(spark, sf_dir)


@register("project", "flight_id:i frame_id:i u:4 v:4 valid:b",
          "SELECT flight_id, frame_id, u, v, coalesce(u >= 0 AND u < 640 AND v >= 0 AND v < 480, false) AS valid FROM p_pix")
def _project(spark, sf_dir):
    return cam.project(_in_camera(spark, sf_dir))


def _pixels_with_depth(spark, sf_dir):
    d = v.intrinsics(v.points(spark, sf_dir))
    return d.withColumns({"u": F.pmod(F.col("r") * 5 + F.col("frame_id"), F.lit(640.0)), "v": F.col("g") * 1.5, "depth": F.col("z") + 2}).drop("x", "y", "z")


cte("d_pix", "SELECT flight_id, frame_id, (r * 5 + frame_id) % 640 AS u, g * 1.5 AS v, z + 2 AS depth FROM v_points")
cte("d_cam", "SELECT *, (u - 320) * depth / 300 AS xc, (v - 240) * depth / 300 AS yc, depth AS zc FROM d_pix")


@register("unproject", "flight_id:i frame_id:i u:3 v:3 xc:6 yc:6 zc:6", "SELECT * FROM d_cam")
def _unproject(spark, sf_dir):
    return cam.unproject(_pixels_with_depth(spark, sf_dir))


@register("unproject_to_world", "flight_id:i frame_id:i x:6 y:6 z:6", """
SELECT flight_id, frame_id, r00*xc + r01*yc + r02*zc + tx AS x, r10*xc + r11*yc + r12*zc + ty AS y, r20*xc + r21*yc + r22*zc + tz AS z
FROM d_cam JOIN v_cams USING (flight_id, frame_id)""")
def _unproject_to_world(spark, sf_dir):
    return cam.unproject_to_world(_pixels_with_depth(spark, sf_dir), v.cams(spark, sf_dir))


@register("ray_dirs", "flight_id:i frame_id:i dx:6 dy:6 dz:6", """
SELECT flight_id, frame_id, x/n AS dx, y/n AS dy, 1/n AS dz FROM (SELECT *, sqrt(x*x + y*y + 1) AS n FROM (SELECT *, (u - 320)/300 AS x, (v - 240)/300 AS y FROM d_pix))""")
def _ray_dirs(spark, sf_dir):
    return cam.ray_dirs(_pixels_with_depth(spark, sf_dir))


# --- frames ------------------------------------------------------------------------------------------------------------

@register("index_frames", "flight_id:i path:s frame_id:i ts:5 is_tracking:b", """
SELECT flight_id, path, frame_id, frame_id / 30 AS ts, frame_id % 3 = 0 AS is_tracking FROM (
SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY path) - 1 AS frame_id FROM (
SELECT flight_id, '/frames/' || flight_id || '/img_' || lpad(CAST((rec_no * 7919) % 100003 AS VARCHAR), 6, '0') || CASE rec_no % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '.tiff' END AS path
FROM v_telemetry) WHERE path NOT LIKE '%.txt')""")
def _index_frames(spark, sf_dir):
    files = v.telemetry(spark, sf_dir).selectExpr("flight_id", """concat('/frames/', flight_id, '/img_', lpad(CAST((rec_no * 7919) % 100003 AS STRING), 6, '0'),
        CASE rec_no % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '.tiff' END) AS path""")
    return fr.index_frames(files, step=3)


cte("v_grey", "SELECT *, floor(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b + 0.5) AS y FROM v_pixels")


@register("frame_quality", "flight_id:i frame_id:i sharpness:3 blur:6 exposure:6 saturation:6", """
SELECT flight_id, frame_id, sharpness, 1 / (1 + ln(1 + greatest(1e-4, sharpness))) AS blur, 1 - abs(m / 255 - 0.5) * 2 AS exposure, sat / 255 AS saturation FROM (
SELECT p.flight_id, p.frame_id, var_pop(a.y + b.y + c.y + d.y - 4 * p.y) AS sharpness, avg(p.y) AS m,
  avg(CASE WHEN greatest(p.r, p.g, p.b) > 0 THEN floor(255.0 * (greatest(p.r, p.g, p.b) - least(p.r, p.g, p.b)) / greatest(p.r, p.g, p.b) + 0.5) ELSE 0 END) AS sat
FROM v_grey p JOIN v_grey a ON a.flight_id = p.flight_id AND a.frame_id = p.frame_id AND a.v = p.v AND a.u = CASE WHEN p.u = 0 THEN 1 ELSE p.u - 1 END
JOIN v_grey b ON b.flight_id = p.flight_id AND b.frame_id = p.frame_id AND b.v = p.v AND b.u = CASE WHEN p.u = 7 THEN 6 ELSE p.u + 1 END
JOIN v_grey c ON c.flight_id = p.flight_id AND c.frame_id = p.frame_id AND c.u = p.u AND c.v = CASE WHEN p.v = 0 THEN 1 ELSE p.v - 1 END
JOIN v_grey d ON d.flight_id = p.flight_id AND d.frame_id = p.frame_id AND d.u = p.u AND d.v = CASE WHEN p.v = 7 THEN 6 ELSE p.v + 1 END
GROUP BY p.flight_id, p.frame_id)""")
def _frame_quality(spark, sf_dir):
    return fr.frame_quality(v.tiles(spark, sf_dir))


cte("v_flow", "SELECT flight_id, frame_id, (r - 120) / 30 AS dx, (g - 120) / 40 AS dy FROM v_points")


@register("flow_dynamics", "flight_id:i frame_id:i flow_magnitude:5 dynamic_share:5", """
SELECT flight_id, frame_id, avg(sqrt(dx*dx + dy*dy)) AS flow_magnitude, avg(CASE WHEN sqrt((dx-mx)*(dx-mx) + (dy-my)*(dy-my)) > 3 THEN 1.0 ELSE 0.0 END) AS dynamic_share
FROM v_flow JOIN (SELECT flight_id, frame_id, quantile_cont(dx, 0.5) AS mx, quantile_cont(dy, 0.5) AS my FROM v_flow GROUP BY 1, 2) USING (flight_id, frame_id) GROUP BY 1, 2""")
def _flow(spark, sf_dir):
    return fr.flow_dynamics(v.points(spark, sf_dir).selectExpr("flight_id", "frame_id", "(r - 120) / 30 AS dx", "(g - 120) / 40 AS dy"))


# Poses whose yaw steps by 7 degrees turn enough at every second frame, so each keyframe is found from the one before it.
cte("k_in", "SELECT flight_id, frame_id, tx, ty, tz, CAST((frame_id * 0.4) AS DOUBLE) AS yaw, CASE WHEN frame_id % 9 IN (4, 5) THEN 0.9 ELSE 0.3 END AS blur, frame_id % 23 NOT IN (7, 8, 9) AS posed FROM v_poses")
cte("k_fold", """
SELECT flight_id, 0 AS frame_id, 0 AS mem, true AS kept FROM (SELECT DISTINCT flight_id FROM k_in)
UNION ALL
SELECT flight_id, nf, CASE WHEN posed THEN nf ELSE mem END, true FROM (
  SELECT k.flight_id, k.mem, n.frame_id AS nf, n.posed, row_number() OVER (PARTITION BY k.flight_id ORDER BY n.frame_id) AS rn
  FROM k_fold k JOIN k_in n ON n.flight_id = k.flight_id AND n.frame_id > k.frame_id
  WHERE n.frame_id - k.frame_id >= 2 AND NOT (n.blur > 0.85 AND n.frame_id - k.frame_id < 12)
    AND (n.frame_id - k.frame_id >= 12 OR (n.posed AND abs(n.frame_id - k.mem) * 0.4 >= 3.0 - 1e-9))) WHERE rn = 1""")


@register("select_keyframes", "flight_id:i frame_id:i", """
SELECT flight_id, frame_id FROM k_fold UNION SELECT flight_id, max(frame_id) FROM k_in GROUP BY flight_id""")
def _select_keyframes(spark, sf_dir):
    turn = "radians(frame_id * 0.4D)"
    p = v.poses(spark, sf_dir).selectExpr(
        "flight_id", "frame_id", "CASE WHEN frame_id % 9 IN (4, 5) THEN 0.9D ELSE 0.3D END AS blur", "frame_id % 23 NOT IN (7, 8, 9) AS posed",
        f"cos({turn}) AS r00", f"-sin({turn}) AS r01", "0D AS r02", f"sin({turn}) AS r10", f"cos({turn}) AS r11", "0D AS r12", "0D AS r20", "0D AS r21", "1D AS r22",
        "0D AS tx", "0D AS ty", "0D AS tz")
    p = p.withColumns({c: F.when(F.col("posed"), F.col(c)) for c in R.R_NAMES + ["tx", "ty", "tz"]})
    # 3 degrees is a multiple of no frame step but 7.5 steps, so no rotation lies on the limit.
    return fr.select_keyframes(p, min_baseline=0.5, min_angle=3.0, max_gap=12, fold_rows=400)


cte("w_key", "SELECT flight_id, frame_id, row_number() OVER (PARTITION BY flight_id ORDER BY frame_id) - 1 AS rank, count(*) OVER (PARTITION BY flight_id) AS n FROM v_poses")


@register("make_windows", "flight_id:i window_id:i frame_id:i rank:i in_previous:b in_next:b", """
SELECT flight_id, w AS window_id, frame_id, rank, w > 0 AND rank < (w - 1) * 6 + 10 AS in_previous, w < l AND rank >= (w + 1) * 6 AS in_next
FROM (SELECT *, greatest(0, ceil((n - 10) / 6)) AS l FROM w_key), (SELECT unnest(range(100000)) AS w) WHERE w <= l AND rank >= w * 6 AND rank < w * 6 + 10""")
def _make_windows(spark, sf_dir):
    return fr.make_windows(v.poses(spark, sf_dir).select("flight_id", "frame_id"), 10, 4)


@register("anchors", "flight_id:i frame_id:i", """
WITH f AS (SELECT flight_id, frame_id, row_number() OVER (PARTITION BY flight_id ORDER BY frame_id) - 1 AS r, count(*) OVER (PARTITION BY flight_id) AS n FROM v_poses)
SELECT flight_id, frame_id FROM f WHERE n <= 48 OR (ceil(n / 8) <= 48 AND r % 8 = 0)
UNION SELECT f.flight_id, f.frame_id FROM f, (SELECT unnest(range(48)) AS k) WHERE ceil(n / 8) > 48 AND r = round_even(k * ((n - 1) / 47), 0)""")
def _anchors(spark, sf_dir):
    return fr.anchors(v.poses(spark, sf_dir).select("flight_id", "frame_id"), 48)


cte("z_pairs", "SELECT c.flight_id, c.frame_id, r02*(x-tx) + r12*(y-ty) + r22*(z-tz) AS z FROM v_cams c JOIN v_surfels s USING (flight_id)")
cte("v_range", """
SELECT flight_id, frame_id, lo, CASE WHEN hi <= lo * 1.05 THEN greatest(lo * 3, 100) ELSE hi END AS hi FROM (
SELECT c.flight_id, c.frame_id, CASE WHEN coalesce(1 / (p98 * 1.15), 1) <= 0.1 THEN 1 ELSE coalesce(1 / (p98 * 1.15), 1) END AS lo, coalesce(1 / (p2 * 0.85), 100) AS hi
FROM v_cams c LEFT JOIN (SELECT flight_id, frame_id, quantile_cont(1 / z, 0.02) AS p2, quantile_cont(1 / z, 0.98) AS p98 FROM z_pairs WHERE z > 0.2 GROUP BY 1, 2
HAVING count(*) >= 20 AND quantile_cont(1 / z, 0.98) * 1.15 > quantile_cont(1 / z, 0.02) * 0.85) USING (flight_id, frame_id))""")


@register("depth_range", "flight_id:i frame_id:i lo:5 hi:5", "SELECT * FROM v_range")
def _depth_range(spark, sf_dir):
    return fr.depth_range(v.surfels(spark, sf_dir), v.cams(spark, sf_dir))


@register("pick_sources", "flight_id:i frame_id:i source:i score:6 rank:i", """
WITH t AS (SELECT *, least(25, greatest(0.15, 0.5 * (2 + 6 + frame_id % 9) / 10)) AS target FROM v_cams),
p AS (SELECT a.flight_id, a.frame_id, b.frame_id AS source, a.target, sqrt((a.tx-b.tx)**2 + (a.ty-b.ty)**2 + (a.tz-b.tz)**2) AS b, a.r02*b.r02 + a.r12*b.r12 + a.r22*b.r22 AS c
  FROM t a JOIN t b ON a.flight_id = b.flight_id AND a.frame_id <> b.frame_id),
s AS (SELECT *, c * exp(-(ln(greatest(b, 1e-3) / target) ** 2) / 1.6) AS score FROM p WHERE b >= least(0.05, target * 0.15) AND c >= 0.55)
SELECT *, row_number() OVER (PARTITION BY flight_id, frame_id ORDER BY round(score, 9) DESC, source DESC) AS rank FROM s QUALIFY rank <= 6""")
def _pick_sources(spark, sf_dir):
    return fr.pick_sources(v.cams(spark, sf_dir).selectExpr("*", "2D AS lo", "6D + frame_id % 9 AS hi"), first_radius=0.5)


@register("loop_candidates", "flight_id:i frame_id:i frame_id_2:i distance:4", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY frame_id) - 1 AS r, 30 + (frame_id * 13) % 60 AS features FROM v_poses)
SELECT a.flight_id, a.frame_id, b.frame_id AS frame_id_2, sqrt((a.tx-b.tx)**2 + (a.ty-b.ty)**2 + (a.tz-b.tz)**2) AS distance
FROM k a JOIN k b ON a.flight_id = b.flight_id AND b.r - a.r >= 30 AND a.features >= 50 AND b.features >= 50
WHERE sqrt((a.tx-b.tx)**2 + (a.ty-b.ty)**2 + (a.tz-b.tz)**2) <= 60""")
def _loop_candidates(spark, sf_dir):
    return fr.loop_candidates(v.poses(spark, sf_dir).withColumn("features", F.expr("30 + (frame_id * 13) % 60")), max_distance=60.0)


@register("seed_pairs", "flight_id:i frame_id:i frame_id_2:i shared:i motion:4 score:3 rank:i", """
WITH f AS (SELECT flight_id, frame_id, row_number() OVER (PARTITION BY flight_id ORDER BY frame_id) - 1 AS r FROM (SELECT DISTINCT flight_id, frame_id FROM v_track_obs)),
p AS (SELECT a.flight_id, a.frame_id, b.frame_id AS frame_id_2 FROM f a JOIN f b ON a.flight_id = b.flight_id AND a.r < 40 AND b.r - a.r IN (4, 7, 10, 14, 20)),
m AS (SELECT p.*, sqrt((y.u - x.u)**2 + (y.v - x.v)**2) AS d FROM p JOIN v_track_obs x ON x.flight_id = p.flight_id AND x.frame_id = p.frame_id
  JOIN v_track_obs y ON y.flight_id = p.flight_id AND y.frame_id = p.frame_id_2 AND y.track_id = x.track_id),
g AS (SELECT flight_id, frame_id, frame_id_2, count(*) AS shared, quantile_cont(d, 0.5) AS motion FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND quantile_cont(d, 0.5) >= 5)
SELECT *, shared * least(motion, 60) AS score, row_number() OVER (PARTITION BY flight_id ORDER BY shared * least(motion, 60) DESC, frame_id DESC, frame_id_2 DESC) AS rank FROM g QUALIFY rank <= 12""")
def _seed_pairs(spark, sf_dir):
    return fr.seed_pairs(v.track_obs(spark, sf_dir), top=12, first_frames=40, min_shared=10)
