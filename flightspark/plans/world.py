"""Queries over the grid, the surfel world and its evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.operators import evidence as ev
from flightspark.operators import grid, world
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register

# --- grid ----------------------------------------------------------------------------------------------------------------


@register("voxel_key", "flight_id:i frame_id:i gx:i gy:i gz:i", "SELECT flight_id, frame_id, gx, gy, gz FROM s_points")
def _voxel_key(spark, sf_dir):
    return grid.voxel_key(v.points(spark, sf_dir), 0.08)


@register("radius_join", "flight_id:i q_id:i element_id:i distance:6", """
SELECT a.flight_id, a.element_id AS q_id, b.element_id, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS distance FROM v_surfels a JOIN v_surfels b USING (flight_id)
WHERE b.state <> 'REJECTED' AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.12 AND a.nx*b.nx + a.nz*b.nz >= cos(radians(40))""")
def _radius_join(spark, sf_dir):
    s = v.surfels(spark, sf_dir)
    return grid.radius_join(s.withColumn("q_id", F.col("element_id")), s, 0.12, "q_id", max_angle_deg=40.0)


@register("nearest_neighbor", "flight_id:i q_id:i element_id:i distance:6", """
SELECT a.flight_id, a.element_id AS q_id, arg_min(b.element_id, struct_pack(d := (a.x+0.0371-b.x)**2 + (a.y-0.0513-b.y)**2 + (a.z+0.317-b.z)**2, i := b.element_id)) AS element_id,
  sqrt(min((a.x+0.0371-b.x)**2 + (a.y-0.0513-b.y)**2 + (a.z+0.317-b.z)**2)) AS distance
FROM v_surfels a JOIN v_surfels b USING (flight_id) WHERE b.state <> 'REJECTED' GROUP BY a.flight_id, a.element_id""")
def _nearest(spark, sf_dir):
    s = v.surfels(spark, sf_dir)
    q = s.selectExpr("flight_id", "element_id AS q_id", "x + 0.0371D AS x", "y - 0.0513D AS y", "z + 0.317D AS z")
    return grid.nearest_neighbor(q, s.filter("state <> 'REJECTED'"), "q_id", "element_id", 0.08)


@register("voxel_subsample", "flight_id:i element_id:i x:6", """
SELECT flight_id, min(element_id) AS element_id, arg_min(x, element_id) AS x FROM v_surfels GROUP BY flight_id, floor(x / CAST(0.3 AS DOUBLE)), floor(y / CAST(0.3 AS DOUBLE)), floor(z / CAST(0.3 AS DOUBLE))""")
def _voxel_subsample(spark, sf_dir):
    return grid.voxel_subsample(v.surfels(spark, sf_dir), 0.3, "element_id")


@register("stride_sample", "flight_id:i frame_id:i x:6 y:6 z:6 conf:4", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, frame_id ORDER BY x, y, z, conf, r, g, b) - 1 AS k, count(*) OVER (PARTITION BY flight_id, frame_id) AS n FROM v_points)
WHERE k % CASE WHEN n > 12 THEN CAST(ceil(n / 12) AS BIGINT) ELSE 1 END = 0""")
def _stride(spark, sf_dir):
    return grid.stride_sample(v.points(spark, sf_dir), ["x", "y", "z", "conf", "r", "g", "b"], limit=12)


cte("c_sum", """
SELECT flight_id, frame_id, gx, gy, gz, sum(w) AS w, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z, sum(w*nx) AS nx, sum(w*nz) AS nz, sum(w*r) AS r, sum(w*g) AS g, sum(w*b) AS b, max(conf) AS conf
FROM (SELECT *, greatest(CAST(0.001 AS DOUBLE), conf) AS w FROM s_points) GROUP BY ALL""")
cte("c_obs", """
SELECT flight_id, frame_id, gx, gy, gz, x/w AS x, y/w AS y, z/w AS z, nx/sqrt(nx*nx + nz*nz) AS nx, nz/sqrt(nx*nx + nz*nz) AS nz, r/w AS r, g/w AS g, b/w AS b, conf FROM c_sum""")


@register("cell_aggregate", "flight_id:i frame_id:i gx:i gy:i gz:i x:6 y:6 z:6 nx:6 nz:6 r:4 conf:4 ray_x:5 ray_y:5 ray_z:5", """
SELECT *, (x-tx)/n AS ray_x, (y-ty)/n AS ray_y, (z-tz)/n AS ray_z FROM (SELECT o.*, c.tx, c.ty, c.tz, sqrt((x-tx)**2 + (y-ty)**2 + (z-tz)**2) AS n FROM c_obs o JOIN v_cams c USING (flight_id, frame_id))""")
def _cell_aggregate(spark, sf_dir):
    return grid.cell_aggregate(v.points(spark, sf_dir), 0.08, v.cams(spark, sf_dir))


# --- world ---------------------------------------------------------------------------------------------------------------

def observations(spark, sf_dir):
    """Cell observations with one normal, so that a cell's observations follow one surfel."""
    up = v.points(spark, sf_dir).withColumns({"nx": F.lit(0.0), "nz": F.lit(1.0)})
    return grid.cell_aggregate(up, 0.08, v.cams(spark, sf_dir))


cte("f_obs", "SELECT *, row_number() OVER (PARTITION BY flight_id, gx, gy, gz ORDER BY frame_id) AS k FROM c_obs")
cte("f_fold", """
SELECT flight_id, gx, gy, gz, k, x, y, z, r, greatest(0.3, conf * 0.6) AS score, conf AS mc, 1.0::DOUBLE AS cov, CASE WHEN conf > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS lvl FROM f_obs WHERE k = 1
UNION ALL
SELECT o.flight_id, o.gx, o.gy, o.gz, o.k, (f.k*f.score*f.x + greatest(1e-6, o.conf)*o.x) / (f.k*f.score + greatest(1e-6, o.conf)), (f.k*f.score*f.y + greatest(1e-6, o.conf)*o.y) / (f.k*f.score + greatest(1e-6, o.conf)),
  (f.k*f.score*f.z + greatest(1e-6, o.conf)*o.z) / (f.k*f.score + greatest(1e-6, o.conf)), (f.k*f.score*f.r + greatest(1e-6, o.conf)*o.r) / (f.k*f.score + greatest(1e-6, o.conf)),
  least(1.0, f.score + o.conf * 0.15), greatest(f.mc, o.conf), f.cov * 0.95, CASE WHEN least(1.0, f.score + o.conf * 0.15) > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END
FROM f_fold f JOIN f_obs o ON o.flight_id = f.flight_id AND o.gx = f.gx AND o.gy = f.gy AND o.gz = f.gz AND o.k = f.k + 1""")
cte("v_fused", "SELECT *, k AS observation_count, cov * 0.0064 AS covariance FROM f_fold QUALIFY k = max(k) OVER (PARTITION BY flight_id, gx, gy, gz)")


@register("fuse_surfels", "flight_id:i sx:i sy:i sz:i observation_count:i x:6 y:6 z:6 r:4 score:6 model_confidence:4 covariance:8 level:s provenance:s", """
SELECT flight_id, gx AS sx, gy AS sy, gz AS sz, observation_count, x, y, z, r, score, mc AS model_confidence, covariance, lvl AS level,
  CASE WHEN observation_count > 1 THEN 'MULTI_VIEW_SUPPORTED' ELSE 'OBSERVED' END AS provenance FROM v_fused""")
def _fuse(spark, sf_dir):
    return world.fuse_surfels(observations(spark, sf_dir), 0.08)


@register("cap_elements", "flight_id:i element_id:i",
          "SELECT flight_id, element_id FROM v_surfels QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY element_id) <= 700")
def _cap(spark, sf_dir):
    return world.cap_elements(v.surfels(spark, sf_dir), 700)


@register("prune_surfels", "flight_id:i element_id:i", "SELECT flight_id, element_id FROM v_surfels WHERE confidence_score >= 0.7503 AND state <> 'REJECTED'")
def _prune(spark, sf_dir):
    return world.prune_surfels(v.surfels(spark, sf_dir), 0.7503)


@register("provenance_counts", "flight_id:i provenance:s n:i", """
SELECT f.flight_id, e.p AS provenance, count(s.element_id) AS n FROM (SELECT DISTINCT flight_id FROM v_surfels) f
CROSS JOIN (VALUES ('OBSERVED'), ('MULTI_VIEW_SUPPORTED'), ('STRUCTURAL_INFERRED'), ('GENERATIVE_INFERRED')) e(p) LEFT JOIN v_surfels s ON s.flight_id = f.flight_id AND s.provenance = e.p GROUP BY 1, 2""")
def _provenance(spark, sf_dir):
    return world.provenance_counts(v.surfels(spark, sf_dir))


@register("confidence_counts", "flight_id:i confidence_level:s n:i", """
SELECT f.flight_id, e.p AS confidence_level, count(s.element_id) AS n FROM (SELECT DISTINCT flight_id FROM v_surfels) f
CROSS JOIN (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('UNKNOWN')) e(p) LEFT JOIN v_surfels s ON s.flight_id = f.flight_id AND s.confidence_level = e.p GROUP BY 1, 2""")
def _confidence(spark, sf_dir):
    return world.confidence_counts(v.surfels(spark, sf_dir))


@register("repose_surfels", "flight_id:i element_id:i x:5 y:5 z:5 nx:5 ny:5 nz:5", """
SELECT s.flight_id, element_id, -(y - ty) + tx + 0.1 AS x, (x - tx) + ty - 0.2 AS y, z + 0.05 AS z, -ny AS nx, nx AS ny, nz
FROM v_surfels s JOIN v_cams c ON c.flight_id = s.flight_id AND c.frame_id = s.f0""")
def _repose(spark, sf_dir):
    old = v.cams(spark, sf_dir)
    turned = {"r00": "-r10", "r01": "-r11", "r02": "-r12", "r10": "r00", "r11": "r01", "r12": "r02", "tx": "tx + 0.1D", "ty": "ty - 0.2D", "tz": "tz + 0.05D"}
    new = old.selectExpr(*[f"{turned.get(c, c)} AS {c}" for c in old.columns])
    return world.repose_surfels(v.surfels(spark, sf_dir), old, new)


# --- evidence ------------------------------------------------------------------------------------------------------------

cte("e_view", """
SELECT s.flight_id, s.element_id, s.r, s.g, s.b, c.frame_id, c.r00*(x-tx) + c.r10*(y-ty) + c.r20*(z-tz) AS xc, c.r01*(x-tx) + c.r11*(y-ty) + c.r21*(z-tz) AS yc, c.r02*(x-tx) + c.r12*(y-ty) + c.r22*(z-tz) AS zc,
  -(nx*(x-tx) + nz*(z-tz)) / greatest(1e-6, sqrt((x-tx)**2 + (y-ty)**2 + (z-tz)**2)) AS facing
FROM v_surfels s JOIN v_cams c USING (flight_id)""")
cte("v_cand", """
SELECT * FROM (SELECT *, 15*xc/zc + 16 AS u, 15*yc/zc + 12 AS v FROM e_view WHERE zc > 0.1 AND facing >= cos(radians(65))) WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 24""")
cte("v_tests", f"""
SELECT flight_id, element_id, frame_id, sup AS supporting, NOT sup AND inside AS tested, CASE WHEN sup THEN true WHEN inside THEN d < 45 ELSE false END AS agrees,
  CASE WHEN NOT sup AND inside THEN CASE WHEN d < 45 THEN d / 15 ELSE 5.25 END END AS error
FROM (SELECT c.*, f.frame_id IS NOT NULL AS sup, pu >= 2 AND pu < 30 AND pv >= 2 AND pv < 22 AS inside, abs({v.pixel_sql('c.frame_id', 'pu', 'pv')} - floor((r + g + b) / 3)) AS d
FROM (SELECT *, CAST(round_even(u, 0) AS BIGINT) AS pu, CAST(round_even(v, 0) AS BIGINT) AS pv FROM v_cand) c
LEFT JOIN v_surfel_frames f ON f.flight_id = c.flight_id AND f.element_id = c.element_id AND f.frame_id = c.frame_id)""")
cte("v_updated", """
SELECT s.flight_id, s.element_id, s.observation_count + coalesce(n, 0) AS observation_count, coalesce(e, 1.0) AS reprojection_error, s.provenance AS p0
FROM v_surfels s LEFT JOIN (SELECT flight_id, element_id, sum(CASE WHEN tested AND agrees THEN 1 ELSE 0 END) AS n, avg(error) AS e FROM v_tests GROUP BY 1, 2) t USING (flight_id, element_id)""")


@v.derived("candidates")
def _candidates(spark, sf_dir):
    return ev.candidate_views(v.surfels(spark, sf_dir), v.proxy_cams(spark, sf_dir))


def _support(spark, sf_dir):
    return v.surfels(spark, sf_dir).select("flight_id", "element_id", F.explode("supporting_frames").alias("frame_id"))


@v.derived("tests")
def _tests(spark, sf_dir):
    return ev.validate_views(_candidates.anew(spark, sf_dir), _support(spark, sf_dir), v.proxy_tiles(spark, sf_dir), v.PROXY_TILE)


def _updated(spark, sf_dir, tests):
    return ev.update_surfel_evidence(v.surfels(spark, sf_dir), tests, _support(spark, sf_dir))


@register("candidate_views", "flight_id:i element_id:i frame_id:i u:4 v:4 zc:5 facing:5", "SELECT * FROM v_cand")
def _candidate_views(spark, sf_dir):
    return _candidates.anew(spark, sf_dir)


@register("validate_views", "flight_id:i element_id:i frame_id:i supporting:b tested:b agrees:b error:5", "SELECT * FROM v_tests")
def _validate(spark, sf_dir):
    return _tests.anew(spark, sf_dir)


cte("v_united", """
SELECT flight_id, element_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames FROM (
SELECT flight_id, element_id, frame_id FROM v_surfel_frames UNION SELECT flight_id, element_id, frame_id FROM v_tests WHERE tested AND agrees) GROUP BY 1, 2""")


@register("update_surfel_evidence", "flight_id:i element_id:i observation_count:i reprojection_error:4 visibility:s provenance:s frames:s", """
SELECT * REPLACE (reprojection_error + 0.0000137 AS reprojection_error), CASE WHEN observation_count >= 1 THEN 'VISIBLE' ELSE 'UNKNOWN' END AS visibility, CASE WHEN observation_count >= 2 AND reprojection_error < 3.5 THEN 'MULTI_VIEW_SUPPORTED'
  WHEN observation_count = 1 THEN 'OBSERVED' ELSE p0 END AS provenance FROM v_updated LEFT JOIN v_united USING (flight_id, element_id)""")
def _update(spark, sf_dir):
    # The small shift moves the means off the rounding borders on which many of them lie.
    d = _updated(spark, sf_dir, _tests.anew(spark, sf_dir)).withColumn("reprojection_error", F.col("reprojection_error") + 0.0000137)
    return d.withColumn("frames", F.array_join("supporting_frames", ","))


@register("validation_summary", "flight_id:i mean_reprojection_error:5 total_tested:i total_passed:i", """
SELECT flight_id, mean_reprojection_error, total_tested, total_passed FROM (SELECT flight_id, avg(reprojection_error) AS mean_reprojection_error FROM v_updated GROUP BY 1)
JOIN (SELECT flight_id, count(*) AS total_tested, sum(CASE WHEN agrees THEN 1 ELSE 0 END) AS total_passed FROM v_tests GROUP BY 1) USING (flight_id)""")
def _summary(spark, sf_dir):
    return ev.validation_summary(_updated(spark, sf_dir, _tests(spark, sf_dir)), _tests(spark, sf_dir))


@v.derived("rayed")
def rayed(spark, sf_dir):
    """Surfels with their first and last viewing ray."""
    s = v.surfels(spark, sf_dir).withColumns({"n_views": F.size("supporting_frames"), "f0": F.array_min("supporting_frames"), "f1": F.array_max("supporting_frames")})
    c = v.cams(spark, sf_dir)
    for tag in ("0", "1"):
        s = s.join(c.select("flight_id", F.col("frame_id").alias("f" + tag), *[F.col("t" + a).alias("_t" + a) for a in "xyz"]), ["flight_id", "f" + tag])
        n = F.sqrt(sum(((F.col(a) - F.col("_t" + a)) * (F.col(a) - F.col("_t" + a)) for a in "yz"), (F.col("x") - F.col("_tx")) * (F.col("x") - F.col("_tx"))))
        s = s.withColumns({f"ray{tag}_{a}": (F.col(a) - F.col("_t" + a)) / n for a in "xyz"}).drop("_tx", "_ty", "_tz")
    return s.withColumns({f"ray1_{a}": F.when(F.col("n_views") > 1, F.col(f"ray1_{a}")) for a in "xyz"})


cte("v_scored", """
SELECT *, CASE WHEN state = 'REJECTED' THEN 'UNKNOWN' WHEN n >= 2 AND err < 3 AND score >= 0.7 THEN 'HIGH' WHEN n >= 1 AND score >= 0.4 THEN 'MEDIUM' WHEN score > 0.15 THEN 'LOW' ELSE 'UNKNOWN' END AS level FROM (
SELECT flight_id, element_id, state, provenance, n, err, CASE WHEN state = 'REJECTED' THEN 0 ELSE least(1, greatest(0, (0.30 * least(1, greatest(0, (n - 1) / 3)) + 0.25 * least(1, greatest(0, 1 - err / 4)) + 0.20 * ang
  + 0.15 * model_confidence + 0.10 * gps_confidence) * (1 - dynamic_probability) * CASE WHEN semantic_class = 'vegetation' THEN 0.7 WHEN semantic_class IN ('building', 'facade', 'roof') THEN 1.15 ELSE 1 END)) END AS score
FROM (SELECT s.*, s.observation_count AS n, reprojection_error AS err, CASE WHEN s.observation_count < 2 THEN 0.5 ELSE least(1, degrees(acos(least(1, greatest(-1,
  ((x-a.tx)*(x-b.tx) + (y-a.ty)*(y-b.ty) + (z-a.tz)*(z-b.tz)) / sqrt((x-a.tx)**2 + (y-a.ty)**2 + (z-a.tz)**2) / sqrt((x-b.tx)**2 + (y-b.ty)**2 + (z-b.tz)**2))))) / 15) END AS ang
FROM v_surfels s JOIN v_cams a ON a.flight_id = s.flight_id AND a.frame_id = s.f0 JOIN v_cams b ON b.flight_id = s.flight_id AND b.frame_id = s.f1))""")


@register("score_confidence", "flight_id:i element_id:i confidence_score:4 confidence_level:s provenance:s", """
SELECT flight_id, element_id, score + 0.0000137 AS confidence_score, level AS confidence_level, CASE WHEN level = 'HIGH' AND provenance = 'OBSERVED' THEN 'MULTI_VIEW_SUPPORTED' ELSE provenance END AS provenance FROM v_scored""")
def _score(spark, sf_dir):
    return ev.score_confidence(rayed(spark, sf_dir)).withColumn("confidence_score", F.col("confidence_score") + 0.0000137)


cte("v_rule", """
SELECT *, CASE WHEN state = 'REJECTED' THEN 'unchanged' WHEN exg > 0.14 AND NOT wall AND dz > -0.5 THEN 'vegetation' WHEN b > r + 12 AND b > g + 8 AND up AND dz <= 1 THEN 'water'
  WHEN mv AND dz <= 2 AND sat > 0.15 THEN 'vehicle' WHEN mv AND dz <= 1.8 THEN 'person' WHEN mv THEN 'unchanged' WHEN wall AND dz > 1.2 THEN 'facade' WHEN up AND dz > 2.8 THEN 'roof'
  WHEN up AND dz BETWEEN -0.8 AND 0.4 AND sat < 0.2 AND tot < 360 THEN 'road' WHEN dz <= 0.8 THEN 'ground' WHEN dz > 2 THEN 'building' ELSE 'unknown' END AS rule
FROM (SELECT s.*, z - zg AS dz, (2*g - r - b) / greatest(1, r+g+b) AS exg, greatest(1, r+g+b) AS tot, (greatest(r,g,b) - least(r,g,b)) / greatest(1, r, g, b) AS sat, abs(nz) < 0.4 AS wall, nz > 0.65 AS up,
  z - zg BETWEEN 0.2 AND 2.8 AND (reprojection_error > 2.2 OR observation_count <= 2) AS mv
FROM v_surfels s JOIN (SELECT flight_id, quantile_cont(z, 0.1) AS zg FROM v_surfels GROUP BY 1) USING (flight_id))""")
cte("v_classified", """
SELECT *, CASE WHEN rule IN ('vehicle', 'person') OR single THEN 'REJECTED' ELSE state END AS new_state,
  CASE WHEN single AND rule NOT IN ('vehicle', 'person') THEN 0.8 WHEN rule IN ('vegetation', 'water') THEN 0.05 WHEN rule = 'vehicle' THEN 0.85 WHEN rule = 'person' THEN 0.8 WHEN rule IN ('unchanged', 'unknown') THEN dynamic_probability ELSE 0 END AS dyn
FROM (SELECT *, CASE WHEN rule = 'unchanged' THEN semantic_class ELSE rule END AS cls, state <> 'REJECTED' AND observation_count = 1 AND reprojection_error > 2.5
  AND CASE WHEN rule = 'unchanged' THEN semantic_class ELSE rule END IN ('road', 'ground') AS single FROM v_rule)""")


@register("classify_semantics", "flight_id:i element_id:i semantic_class:s dynamic_probability:3 state:s counted:b", """
SELECT flight_id, element_id, cls AS semantic_class, dyn AS dynamic_probability, new_state AS state, state <> 'REJECTED' AND NOT (single AND rule NOT IN ('vehicle', 'person')) AS counted FROM v_classified""")
def _classify(spark, sf_dir):
    return ev.classify_semantics(v.surfels(spark, sf_dir))


cte("h_target", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY element_id) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY flight_id) // 60) AS st
FROM v_surfels WHERE confidence_level = 'HIGH' AND semantic_class IN ('facade', 'roof', 'building')) WHERE k % st = 0 AND k / st < 60""")
cte("v_hr", """
SELECT t.*, f.frame_id FROM h_target t JOIN (SELECT flight_id, element_id, frame_id FROM v_surfel_frames QUALIFY row_number() OVER (PARTITION BY flight_id, element_id ORDER BY (frame_id * 17) % 101 DESC, frame_id) = 1) f USING (flight_id, element_id)""")


def _hr_targets(spark, sf_dir, limit=None):
    frames = v.cams(spark, sf_dir).selectExpr("flight_id", "frame_id", "CAST((frame_id * 17) % 101 AS DOUBLE) AS sharpness")
    return ev.select_hr_targets(v.surfels(spark, sf_dir), frames, limit)


@register("select_hr_targets", "flight_id:i element_id:i frame_id:i", "SELECT flight_id, element_id, frame_id FROM v_hr")
def _select_hr(spark, sf_dir):
    return _hr_targets(spark, sf_dir, 60)


# Refinement looks at all targets.
cte("v_hr_all", """
SELECT t.*, f.frame_id FROM v_surfels t JOIN (SELECT flight_id, element_id, frame_id FROM v_surfel_frames QUALIFY row_number() OVER (PARTITION BY flight_id, element_id ORDER BY (frame_id * 17) % 101 DESC, frame_id) = 1) f USING (flight_id, element_id)
WHERE confidence_level = 'HIGH' AND semantic_class IN ('facade', 'roof', 'building')""")


# Sobel kernels over an 11 x 11 patch with mirrored border, as offsets into the patch.
_SOBEL = """
WITH p AS (SELECT *, CAST(round_even(15*xc/zc + 16, 0) AS BIGINT) AS pu, CAST(round_even(15*yc/zc + 12, 0) AS BIGINT) AS pv FROM (
  SELECT h.flight_id, h.element_id, h.frame_id, c.r00*(x-tx) + c.r10*(y-ty) + c.r20*(z-tz) AS xc, c.r01*(x-tx) + c.r11*(y-ty) + c.r21*(z-tz) AS yc, c.r02*(x-tx) + c.r12*(y-ty) + c.r22*(z-tz) AS zc
  FROM v_hr_all h JOIN v_cams c USING (flight_id, frame_id)) WHERE zc > 1e-4 AND 15*xc/zc + 16 >= 0 AND 15*xc/zc + 16 < 32 AND 15*yc/zc + 12 >= 0 AND 15*yc/zc + 12 < 24),
q AS (SELECT * FROM p WHERE pu >= 6 AND pu < 26 AND pv >= 6 AND pv < 18),
o AS (SELECT i.i AS i, j.i AS j FROM (SELECT unnest(range(-1, 12)) AS i) i, (SELECT unnest(range(-1, 12)) AS i) j),
px AS (SELECT flight_id, element_id, i, j, PIXEL AS y FROM (SELECT q.*, o.i, o.j, pu - 5 + CASE WHEN i = -1 THEN 1 WHEN i = 11 THEN 9 ELSE i END AS uu, pv - 5 + CASE WHEN j = -1 THEN 1 WHEN j = 11 THEN 9 ELSE j END AS vv FROM q, o)),
gr AS (SELECT c.flight_id, c.element_id, c.i, c.j, sum(n.y * (n.i - c.i) * CASE WHEN n.j = c.j THEN 2 ELSE 1 END) AS gx, sum(n.y * (n.j - c.j) * CASE WHEN n.i = c.i THEN 2 ELSE 1 END) AS gy
  FROM px c JOIN px n ON n.flight_id = c.flight_id AND n.element_id = c.element_id AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 WHERE c.i BETWEEN 0 AND 10 AND c.j BETWEEN 0 AND 10 GROUP BY 1, 2, 3, 4),
e AS (SELECT flight_id, element_id, max(sqrt(gx*gx + gy*gy)) AS edge FROM gr GROUP BY 1, 2)
SELECT h.flight_id, h.element_id, coalesce(edge > 700, false) AS refined, CASE WHEN edge > 700 THEN least(1, model_confidence * 1.1) ELSE model_confidence END AS model_confidence,
  CASE WHEN edge > 700 THEN least(1, confidence_score + 0.05) ELSE confidence_score END AS confidence_score FROM v_hr_all h LEFT JOIN e USING (flight_id, element_id)"""


@register("hr_refine", "flight_id:i element_id:i refined:b model_confidence:5 confidence_score:5", _SOBEL.replace("PIXEL", v.pixel_sql("frame_id", "uu", "vv")))
def _hr_refine(spark, sf_dir):
    return ev.hr_refine(_hr_targets(spark, sf_dir), v.proxy_cams(spark, sf_dir), v.proxy_tiles(spark, sf_dir), v.PROXY_TILE, threshold=700.0)


@register("visibility_classes", "flight_id:i visibility:s n:i", """
SELECT f.flight_id, e.p AS visibility, count(s.element_id) AS n FROM (SELECT DISTINCT flight_id FROM v_surfels) f CROSS JOIN (VALUES ('VISIBLE'), ('OCCLUDED'), ('UNKNOWN')) e(p)
LEFT JOIN v_surfels s ON s.flight_id = f.flight_id AND e.p = 'VISIBLE' GROUP BY 1, 2""")
def _visibility(spark, sf_dir):
    return ev.visibility_classes(v.surfels(spark, sf_dir))
