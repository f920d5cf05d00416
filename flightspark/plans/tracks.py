"""Queries over feature tracks and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.operators import tracks as tr
from flightspark.operators.scale import shuffled
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register

# --- observations of known points: each surfel seen by its supporting frames, with a small fixed disturbance -------------

_SHIFT = "((element_id * 31 + frame_id * 17) % 11 - 5) * CAST(0.04 AS DOUBLE)"


@v.derived("point_obs")
def point_obs(spark, sf_dir):
    s = v.surfels(spark, sf_dir).select("flight_id", "element_id", "x", "y", "z", F.explode("supporting_frames").alias("frame_id"))
    d = shuffled(s).join(v.cams(spark, sf_dir), ["flight_id", "frame_id"]).selectExpr(
        "*", "r00*(x-tx) + r10*(y-ty) + r20*(z-tz) AS xc", "r01*(x-tx) + r11*(y-ty) + r21*(z-tz) AS yc", "r02*(x-tx) + r12*(y-ty) + r22*(z-tz) AS zc")
    far = "CASE WHEN (element_id + frame_id) % 37 = 0 THEN 25D ELSE 0D END"
    return d.selectExpr("flight_id", "element_id AS track_id", "frame_id", f"300*xc/zc + 320 + {_SHIFT} + {far} AS u", f"300*yc/zc + 240 - {_SHIFT} AS v")


cte("v_point_obs", f"""
SELECT flight_id, element_id AS track_id, frame_id, 300*xc/zc + 320 + {_SHIFT} + CASE WHEN (element_id + frame_id) % 37 = 0 THEN 25 ELSE 0 END AS u, 300*yc/zc + 240 - {_SHIFT} AS v
FROM (SELECT f.flight_id, f.element_id, f.frame_id, r00*(x-tx) + r10*(y-ty) + r20*(z-tz) AS xc, r01*(x-tx) + r11*(y-ty) + r21*(z-tz) AS yc, r02*(x-tx) + r12*(y-ty) + r22*(z-tz) AS zc
  FROM v_surfel_frames f JOIN v_surfels s USING (flight_id, element_id) JOIN v_cams c ON c.flight_id = f.flight_id AND c.frame_id = f.frame_id)""")
cte("v_truth_error", """
SELECT o.flight_id, o.track_id, o.frame_id, sqrt((300*xc/zc + 320 - u)**2 + (300*yc/zc + 240 - v)**2) AS error FROM (
SELECT o.*, r00*(x-tx) + r10*(y-ty) + r20*(z-tz) AS xc, r01*(x-tx) + r11*(y-ty) + r21*(z-tz) AS yc, r02*(x-tx) + r12*(y-ty) + r22*(z-tz) AS zc
FROM v_point_obs o JOIN v_surfels s ON s.flight_id = o.flight_id AND s.element_id = o.track_id JOIN v_cams c ON c.flight_id = o.flight_id AND c.frame_id = o.frame_id) o""")


def full_cams(spark, sf_dir):
    return v.intrinsics(v.cams(spark, sf_dir))


def _truth(spark, sf_dir):
    return v.surfels(spark, sf_dir).selectExpr("flight_id", "element_id AS track_id", "x", "y", "z")


@register("filter_tracks", "flight_id:i track_id:i frame_id:i u:3", """
SELECT flight_id, track_id, frame_id, u FROM v_track_obs WHERE frame_id % 3 <> 0 QUALIFY count(*) OVER (PARTITION BY flight_id, track_id) >= 18""")
def _filter(spark, sf_dir):
    o = v.track_obs(spark, sf_dir)
    return tr.filter_tracks(o, 18, o.select("flight_id", "frame_id").distinct().filter("frame_id % 3 <> 0"))


cte("t_pairs", "SELECT DISTINCT a.flight_id, a.frame_id, a.frame_id + 10 AS frame_id_2 FROM v_track_obs a")


def _step_pairs(obs, step):
    return obs.select("flight_id", "frame_id").distinct().withColumn("frame_id_2", F.col("frame_id") + step)


@register("pair_matches", "flight_id:i frame_id:i frame_id_2:i track_id:i u:6 v2:6", """
SELECT p.*, a.track_id, a.u, b.v AS v2 FROM t_pairs p JOIN v_track_obs a ON a.flight_id = p.flight_id AND a.frame_id = p.frame_id
JOIN v_track_obs b ON b.flight_id = p.flight_id AND b.frame_id = p.frame_id_2 AND b.track_id = a.track_id""")
def _pair_matches(spark, sf_dir):
    o = v.track_obs(spark, sf_dir)
    return tr.pair_matches(o, _step_pairs(o, 10))


@register("track_stats", "flight_id:i tracks:i observations:i min_length:i max_length:i mean_length:5 median_length:2 median_span:2 inliers:i", """
SELECT flight_id, count(*) AS tracks, sum(n) AS observations, min(n) AS min_length, max(n) AS max_length, avg(n) AS mean_length, quantile_cont(n, 0.5) AS median_length,
  quantile_cont(span, 0.5) AS median_span, sum(CASE WHEN track_id % 3 = 0 THEN 1 ELSE 0 END) AS inliers
FROM (SELECT flight_id, track_id, count(*) AS n, max(frame_id) - min(frame_id) AS span FROM v_track_obs GROUP BY 1, 2) GROUP BY 1""")
def _stats(spark, sf_dir):
    o = v.track_obs(spark, sf_dir)
    return tr.track_stats(o, o.select("flight_id", "track_id").distinct().withColumn("is_inlier", F.col("track_id") % 3 == 0))


@register("anchor_drift", "flight_id:i frame_id:i u:4 v:4 kept:b drift_dropped:b", """
SELECT flight_id, frame_id, CASE WHEN t THEN r + dz ELSE r + 1 END AS u, CASE WHEN t THEN g + 1 ELSE g END AS v, k AND t AS kept, k AND NOT t AS drift_dropped FROM (
SELECT *, sqrt(dx*dx + 0.25) < 1.5 AS k, dy < 1.0 AND sqrt((dz - 1)**2 + 1) <= 2.0 AS t FROM (SELECT *, x * 1.03 AS dx, y * 1.07 AS dy, z * 0.51 AS dz FROM v_points))""")
def _drift(spark, sf_dir):
    m = v.points(spark, sf_dir).selectExpr("*", "x * 1.03D AS dx", "y * 1.07D AS dy", "z * 0.51D AS dz").selectExpr(
        "flight_id", "frame_id", "r AS pu", "g AS pv", "r + dx AS bu", "g + 0.5D AS bv", "r + 1 AS cu", "g AS cv", "b AS qu", "r AS qv", "b AS ru", "r + dy AS rv", "r + dz AS au", "g + 1 AS av")
    return tr.anchor_drift(m)


def _features(spark, sf_dir, words: bool):
    e = v.table(spark, sf_dir, "embeddings").selectExpr("CAST(floor(vec_id / 250) AS BIGINT) AS flight_id", "CAST(label AS BIGINT) AS frame_id", "vec_id AS kp", "embedding")
    if words:
        bits = "array(aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (s, b) -> s | b))"
        return e.select("flight_id", "frame_id", "kp", F.expr(bits).alias("desc"))
    return e.select("flight_id", "frame_id", "kp", F.col("embedding").alias("desc"))


def _label_pairs(f):
    frames = f.select("flight_id", "frame_id").distinct()
    return frames.join(frames.withColumnRenamed("frame_id", "frame_id_2"), "flight_id").filter("frame_id < frame_id_2")


_MATCH = """
WITH e AS (SELECT CAST(floor(vec_id / 250) AS BIGINT) AS flight_id, label AS frame_id, vec_id AS kp, embedding FROM embeddings),
x AS (SELECT flight_id, frame_id, kp, i, CAST(embedding[i] AS DOUBLE) AS c FROM e, (SELECT unnest(range(1, 65)) AS i)),
d AS (SELECT a.flight_id, a.frame_id, b.frame_id AS frame_id_2, a.kp, b.kp AS kp_2, DIST AS distance FROM x a JOIN x b ON a.flight_id = b.flight_id AND a.i = b.i AND a.frame_id < b.frame_id GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, frame_id_2, kp ORDER BY distance, kp_2) AS k, lead(distance) OVER (PARTITION BY frame_id, frame_id_2, kp ORDER BY distance, kp_2) AS second FROM d)
SELECT *, count(*) OVER (PARTITION BY flight_id, frame_id, frame_id_2) AS n FROM r WHERE k = 1 AND distance < second * RATIO QUALIFY n >= LEAST"""


def _match_sql(dist, ratio, least):
    return _MATCH.replace("DIST", dist).replace("RATIO", ratio).replace("LEAST", least)


@register("match_descriptors", "flight_id:i frame_id:i frame_id_2:i kp:i kp_2:i distance:i",
          _match_sql("sum(CASE WHEN (a.c > 0) <> (b.c > 0) THEN 1 ELSE 0 END)", "0.9", "3"))
def _match(spark, sf_dir):
    f = _features(spark, sf_dir, True)
    return tr.match_descriptors(f, _label_pairs(f), "hamming", 0.9, 3)


@register("match_descriptors_l2", "flight_id:i frame_id:i frame_id_2:i kp:i kp_2:i distance:5", _match_sql("sqrt(sum((a.c - b.c) * (a.c - b.c)))", "0.95", "2"))
def _match_l2(spark, sf_dir):
    f = _features(spark, sf_dir, False)
    f = f.withColumn("desc", F.col("desc").cast("array<double>"))
    return tr.match_descriptors(f, _label_pairs(f), "l2", 0.95, 2)


def _epipolar_sql() -> str:
    """World-frame form of the same test: with d1, d2 the viewing directions and b the baseline, x2'E x1 = (b x d1) . d2."""
    d1 = [f"(p.r{i}0*x1 + p.r{i}1*y1 + p.r{i}2)" for i in range(3)]
    d2 = [f"(c.r{i}0*x2 + c.r{i}1*y2 + c.r{i}2)" for i in range(3)]
    b = ["(p.tx - c.tx)", "(p.ty - c.ty)", "(p.tz - c.tz)"]
    cross = lambda s, t: [f"({s[1]}*{t[2]} - {s[2]}*{t[1]})", f"({s[2]}*{t[0]} - {s[0]}*{t[2]})", f"({s[0]}*{t[1]} - {s[1]}*{t[0]})"]
    line2, line1 = cross(b, d1), cross(d2, b)
    comp = lambda s, cam, k: "(" + " + ".join(f"{s[i]}*{cam}.r{i}{k}" for i in range(3)) + ")"
    num = "(" + " + ".join(f"{line2[i]}*{d2[i]}" for i in range(3)) + ")"
    den = " + ".join(f"{comp(line2, 'c', k)}**2" for k in (0, 1)) + " + " + " + ".join(f"{comp(line1, 'p', k)}**2" for k in (0, 1))
    return f"""
SELECT flight_id, frame_id, frame_id_2, count(*) AS matches, sum(CASE WHEN s <= 4 THEN 1 ELSE 0 END) AS inliers, avg(CASE WHEN s <= 4 THEN 1.0 ELSE 0.0 END) AS inlier_ratio,
  sum(CASE WHEN s <= 4 THEN 1 ELSE 0 END) / 10 AS weight
FROM (SELECT m.flight_id, m.frame_id, m.frame_id_2, ({num})**2 / greatest(1e-18, {den}) * 90000 AS s FROM (
  SELECT a.flight_id, a.frame_id, b.frame_id AS frame_id_2, (a.u-320)/300 AS x1, (a.v-240)/300 AS y1, (b.u-320)/300 AS x2, (b.v-240)/300 AS y2
  FROM v_point_obs a JOIN v_point_obs b ON a.flight_id = b.flight_id AND a.track_id = b.track_id AND b.frame_id = a.frame_id + 7) m
  JOIN v_cams p ON p.flight_id = m.flight_id AND p.frame_id = m.frame_id JOIN v_cams c ON c.flight_id = m.flight_id AND c.frame_id = m.frame_id_2) GROUP BY 1, 2, 3"""


@register("epipolar_inliers", "flight_id:i frame_id:i frame_id_2:i matches:i inliers:i inlier_ratio:5 weight:2", _epipolar_sql())
def _epipolar(spark, sf_dir):
    o = point_obs(spark, sf_dir)
    return tr.epipolar_inliers(tr.pair_matches(o, _step_pairs(o, 7)), full_cams(spark, sf_dir))


# Features are (track, frame); a track's observations are chained, and every 50th track is also tied to the next one of its flight.
_NODES = "flight_id, track_id * 1000 + frame_id AS node, frame_id, track_id"
cte("m_nodes", f"SELECT {_NODES} FROM v_track_obs")
cte("m_first", "SELECT flight_id, track_id, min(node) AS node FROM m_nodes GROUP BY 1, 2")
cte("m_edges", """
SELECT flight_id, node AS a, lead(node) OVER (PARTITION BY flight_id, track_id ORDER BY frame_id) AS b FROM m_nodes QUALIFY b IS NOT NULL
UNION ALL SELECT x.flight_id, x.node, y.node FROM m_first x JOIN m_first y ON y.flight_id = x.flight_id AND y.track_id = x.track_id + 8 WHERE x.track_id % 50 = 0""")
cte("m_label", "SELECT flight_id, node, CASE WHEN track_id >= 8 AND (track_id - 8) % 50 = 0 AND track_id - 8 IN (SELECT track_id FROM m_first) THEN (SELECT f.node FROM m_first f WHERE f.track_id = m_nodes.track_id - 8) ELSE (SELECT f.node FROM m_first f WHERE f.track_id = m_nodes.track_id) END AS component, frame_id FROM m_nodes")


def _track_graph(spark, sf_dir):
    from pyspark.sql import Window
    n = v.track_obs(spark, sf_dir).selectExpr("flight_id", "track_id * 1000 + frame_id AS node", "frame_id", "track_id")
    chain = n.withColumn("b", F.lead("node").over(Window.partitionBy("flight_id", "track_id").orderBy("frame_id"))).filter("b IS NOT NULL")
    first = n.groupBy("flight_id", "track_id").agg(F.min("node").alias("node"))
    tie = first.filter("track_id % 50 = 0").selectExpr("flight_id", "track_id + 8 AS track_id", "node AS a").join(first.withColumnRenamed("node", "b"), ["flight_id", "track_id"])
    return chain.select("flight_id", F.col("node").alias("a"), "b").unionByName(tie.select("flight_id", "a", "b")), n


@register("connected_components", "flight_id:i node:i component:i", "SELECT flight_id, node, component FROM m_label")
def _components(spark, sf_dir):
    from flightspark.operators.scale import connected_components
    edges, _ = _track_graph(spark, sf_dir)
    return connected_components(edges, ["flight_id"], "a", "b")


cte("m_group", "SELECT flight_id, component, count(*) AS n, count(DISTINCT frame_id) AS frames FROM m_label GROUP BY 1, 2")


@register("merge_tracks", "flight_id:i component:i node:i frame_id:i", """
SELECT l.flight_id, l.component, node, frame_id FROM m_label l JOIN m_group g ON g.flight_id = l.flight_id AND g.component = l.component WHERE n >= 3 AND frames = n""")
def _merge(spark, sf_dir):
    edges, nodes = _track_graph(spark, sf_dir)
    return tr.merge_tracks(edges, nodes)[0]


@register("merge_tracks_report", "flight_id:i kind:s groups:i", """
SELECT flight_id, CASE WHEN n < 3 THEN 'short' WHEN frames < n THEN 'contradictory' ELSE 'kept' END AS kind, count(*) AS groups FROM m_group GROUP BY 1, 2""")
def _merge_report(spark, sf_dir):
    edges, nodes = _track_graph(spark, sf_dir)
    return tr.merge_tracks(edges, nodes)[1]


cte("w_pair", """
SELECT flight_id, track_id, f1 AS frame_id, f2 AS frame_id_2, d AS baseline FROM (
SELECT a.flight_id, a.track_id, a.frame_id AS f1, b.frame_id AS f2, sqrt((p.tx-q.tx)**2 + (p.ty-q.ty)**2 + (p.tz-q.tz)**2) AS d FROM v_point_obs a
JOIN v_point_obs b ON a.flight_id = b.flight_id AND a.track_id = b.track_id AND a.frame_id < b.frame_id
JOIN v_cams p ON p.flight_id = a.flight_id AND p.frame_id = a.frame_id JOIN v_cams q ON q.flight_id = b.flight_id AND q.frame_id = b.frame_id)
QUALIFY row_number() OVER (PARTITION BY flight_id, track_id ORDER BY round(d, 9) DESC, f1, f2) = 1 AND d >= 0.2""")


@register("widest_pair", "flight_id:i track_id:i frame_id:i frame_id_2:i baseline:5", "SELECT * FROM w_pair")
def _widest(spark, sf_dir):
    return tr.widest_pair(point_obs(spark, sf_dir), full_cams(spark, sf_dir))


# Smallest eigenvector in SQL: the adjugate of a nearly singular normal matrix maps any vector onto it; applied four times.

def _minor(rows, cols) -> str:
    (a, b, c), (d, e, f) = rows, cols
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    return (f"({m(a, d)}*({m(b, e)}*{m(c, f)} - {m(b, f)}*{m(c, e)}) - {m(a, e)}*({m(b, d)}*{m(c, f)} - {m(b, f)}*{m(c, d)})"
            f" + {m(a, f)}*({m(b, d)}*{m(c, e)} - {m(b, e)}*{m(c, d)}))")


def _null_sql(source: str) -> str:
    adj = []
    for i in range(4):
        for j in range(i, 4):
            sign = "" if (i + j) % 2 == 0 else "-"
            adj.append(f"{sign}{_minor([k for k in range(4) if k != i], [k for k in range(4) if k != j])} AS a{i}{j}")
    g = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    sql = f"SELECT *, 0.3 AS h0, -0.2 AS h1, 0.5 AS h2, 1.0 AS h3 FROM (SELECT *, {', '.join(adj)} FROM {source})"
    for _ in range(5):
        step = ", ".join("(" + " + ".join(f"{g(i, j)}*h{j}" for j in range(4)) + f") AS n{i}" for i in range(4))
        norm = "sqrt(n0*n0 + n1*n1 + n2*n2 + n3*n3)"
        sql = f"SELECT * EXCLUDE (h0, h1, h2, h3, n0, n1, n2, n3), n0/{norm} AS h0, n1/{norm} AS h1, n2/{norm} AS h2, n3/{norm} AS h3 FROM (SELECT *, {step} FROM ({sql}))"
    return sql


def _normal_sql(source: str, normalise: bool) -> str:
    sums = ", ".join(f"sum(ea{i}*ea{j}/na + eb{i}*eb{j}/nb) AS m{i}{j}" for i in range(4) for j in range(i, 4))
    p = [[f"r{j}{i}" for j in range(3)] + [f"(-(r0{i}*tx + r1{i}*ty + r2{i}*tz))"] for i in range(3)]
    eq = ", ".join(f"(u-320)*{p[2][j]} - 300*{p[0][j]} AS ea{j}, (v-240)*{p[2][j]} - 300*{p[1][j]} AS eb{j}" for j in range(4))
    na, nb = ("ea0*ea0+ea1*ea1+ea2*ea2+ea3*ea3", "eb0*eb0+eb1*eb1+eb2*eb2+eb3*eb3") if normalise else ("1", "1")
    return f"SELECT flight_id, track_id, {sums} FROM (SELECT *, {na} AS na, {nb} AS nb FROM (SELECT o.flight_id, o.track_id, {eq} FROM {source} o JOIN v_cams c ON c.flight_id = o.flight_id AND c.frame_id = o.frame_id)) GROUP BY 1, 2"


cte("g_many", "SELECT * FROM v_point_obs QUALIFY count(*) OVER (PARTITION BY flight_id, track_id) >= 2")
cte("g_norm", _normal_sql("g_many", True))
cte("g_point", f"SELECT flight_id, track_id, h0/h3 AS x, h1/h3 AS y, h2/h3 AS z FROM ({_null_sql('g_norm')})")


def _error_sql(points: str) -> str:
    return f"""SELECT o.flight_id, o.track_id, o.frame_id, o.zc, o.ax, o.ay, o.az, sqrt((300*xc/zc + 320 - u)**2 + (300*yc/zc + 240 - v)**2) AS error FROM (
SELECT o.*, s.x - tx AS ax, s.y - ty AS ay, s.z - tz AS az, r00*(s.x-tx) + r10*(s.y-ty) + r20*(s.z-tz) AS xc, r01*(s.x-tx) + r11*(s.y-ty) + r21*(s.z-tz) AS yc, r02*(s.x-tx) + r12*(s.y-ty) + r22*(s.z-tz) AS zc
FROM v_point_obs o JOIN {points} s ON s.flight_id = o.flight_id AND s.track_id = o.track_id JOIN v_cams c ON c.flight_id = o.flight_id AND c.frame_id = o.frame_id) o"""


cte("g_error", _error_sql("g_point"))
cte("g_ray", "SELECT flight_id, track_id, ax/n AS x, ay/n AS y, az/n AS z FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS n FROM g_error)")


@register("triangulate", "flight_id:i track_id:i x:4 y:4 z:3 mean_error:3", """
SELECT p.flight_id, p.track_id, p.x, p.y, p.z, mean_error FROM g_point p JOIN (SELECT flight_id, track_id, avg(error) AS mean_error FROM g_error GROUP BY 1, 2 HAVING min(zc) > 0.05 AND avg(error) <= 4) e
  ON e.flight_id = p.flight_id AND e.track_id = p.track_id
JOIN (SELECT a.flight_id, a.track_id FROM g_ray a JOIN g_ray b ON a.flight_id = b.flight_id AND a.track_id = b.track_id GROUP BY 1, 2 HAVING min(a.x*b.x + a.y*b.y + a.z*b.z) <= cos(radians(1))) w
  ON w.flight_id = p.flight_id AND w.track_id = p.track_id""")
def _triangulate(spark, sf_dir):
    return tr.triangulate(point_obs(spark, sf_dir), full_cams(spark, sf_dir))


cte("l_ends", "SELECT o.* FROM v_point_obs o JOIN w_pair w ON w.flight_id = o.flight_id AND w.track_id = o.track_id AND o.frame_id IN (w.frame_id, w.frame_id_2)")
cte("l_norm", _normal_sql("l_ends", False))
cte("l_point", f"SELECT flight_id, track_id, h0/h3 AS x, h1/h3 AS y, h2/h3 AS z FROM ({_null_sql('l_norm')})")
cte("l_error", _error_sql("l_point"))


@register("verify_landmarks", "flight_id:i track_id:i x:1 y:1 is_inlier:b", """
SELECT p.flight_id, p.track_id, CASE WHEN e < 4 THEN p.x + 0.0137 END AS x, CASE WHEN e < 4 THEN p.y + 0.0137 END AS y, e < 4 AS is_inlier FROM l_point p JOIN (SELECT flight_id, track_id, avg(error) AS e FROM l_error WHERE zc > 0.1 GROUP BY 1, 2) m
  ON m.flight_id = p.flight_id AND m.track_id = p.track_id
JOIN (SELECT r.flight_id, r.track_id FROM l_error r JOIN w_pair w ON w.flight_id = r.flight_id AND w.track_id = r.track_id AND r.frame_id IN (w.frame_id, w.frame_id_2) GROUP BY 1, 2 HAVING min(zc) > 0.1) f
  ON f.flight_id = p.flight_id AND f.track_id = p.track_id""")
def _verify(spark, sf_dir):
    # Two views a few decimetres apart fix a point only roughly, so positions are compared coarsely and for inliers.
    d = tr.verify_landmarks(point_obs(spark, sf_dir), full_cams(spark, sf_dir))
    return d.withColumns({c: F.when(F.col("is_inlier"), F.col(c) + 0.0137) for c in "xy"})


@register("reprojection_errors", "flight_id:i track_id:i frame_id:i error:4", "SELECT * FROM v_truth_error")
def _reprojection(spark, sf_dir):
    return tr.reprojection_errors(point_obs(spark, sf_dir), full_cams(spark, sf_dir), _truth(spark, sf_dir))


@register("prune_observations", "flight_id:i track_id:i frame_id:i error:4", """
WITH m AS (SELECT flight_id, quantile_cont(error, 0.5) AS med FROM v_truth_error GROUP BY 1),
c AS (SELECT e.flight_id, greatest(2, any_value(med) + 4 * greatest(0.15, 1.4826 * quantile_cont(abs(error - med), 0.5))) AS cut FROM v_truth_error e JOIN m USING (flight_id) GROUP BY 1),
b AS (SELECT e.*, error > cut AS bad, count(*) OVER w AS n, sum(CASE WHEN error > cut THEN 1 ELSE 0 END) OVER w AS nb FROM v_truth_error e JOIN c USING (flight_id) WINDOW w AS (PARTITION BY e.flight_id, track_id)),
k AS (SELECT * FROM b WHERE NOT bad OR n - nb < 3)
SELECT flight_id, track_id, frame_id, error FROM k QUALIFY count(*) OVER (PARTITION BY flight_id, track_id) >= 2 AND quantile_cont(error, 0.5) OVER (PARTITION BY flight_id, track_id) <= 5""")
def _prune(spark, sf_dir):
    return tr.prune_observations(point_obs(spark, sf_dir), full_cams(spark, sf_dir), _truth(spark, sf_dir))


@register("thin_observations", "flight_id:i track_id:i frame_id:i", """
WITH n AS (SELECT flight_id, track_id, count(*) AS n, row_number() OVER (PARTITION BY flight_id ORDER BY count(*) DESC, track_id) AS r FROM v_track_obs GROUP BY 1, 2 QUALIFY r <= 200),
o AS (SELECT o.flight_id, o.track_id, frame_id, n, row_number() OVER (PARTITION BY o.flight_id, o.track_id ORDER BY frame_id) - 1 AS i FROM v_track_obs o JOIN n ON n.flight_id = o.flight_id AND n.track_id = o.track_id)
SELECT DISTINCT flight_id, track_id, frame_id FROM o WHERE n <= 24 OR i IN (SELECT round_even(k * ((o.n - 1) / 23), 0) FROM (SELECT unnest(range(24)) AS k))""")
def _thin(spark, sf_dir):
    return tr.thin_observations(v.track_obs(spark, sf_dir), 200, 24)
