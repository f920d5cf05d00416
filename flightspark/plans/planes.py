"""Queries over planes and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.operators import planes as pl
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register
from flightspark.session import checkpointed

# Off the round values that distances of this lattice take.
_NEAR = 0.0613
_ORDER = "((element_id % 1000003) * 7919) % 1000003"
cte("h_draw", f"SELECT flight_id, element_id, x, y, z, row_number() OVER (PARTITION BY flight_id ORDER BY {_ORDER}, element_id) - 1 AS k FROM v_surfels QUALIFY k < 150")
cte("h_hyp", """
SELECT flight_id, hyp, nx/n AS nx, ny/n AS ny, nz/n AS nz, -(nx*x0 + ny*y0 + nz*z0)/n AS d FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS n FROM (
SELECT a.flight_id, a.k // 3 AS hyp, a.x AS x0, a.y AS y0, a.z AS z0, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz
FROM h_draw a JOIN h_draw b ON b.flight_id = a.flight_id AND b.k = a.k + 1 JOIN h_draw c ON c.flight_id = a.flight_id AND c.k = a.k + 2 WHERE a.k % 3 = 0)) WHERE n >= 1e-6""")
cte("h_best", """
SELECT h.*, inliers FROM (SELECT h.flight_id, h.hyp, count(*) AS inliers FROM v_surfels s JOIN h_hyp h USING (flight_id) WHERE abs(h.nx*x + h.ny*y + h.nz*z + d) < 0.0813 GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY h.flight_id ORDER BY count(*) DESC, h.hyp) = 1) b JOIN h_hyp h ON h.flight_id = b.flight_id AND h.hyp = b.hyp""")


@v.derived("plane")
def plane(spark, sf_dir):
    return pl.plane_ransac(v.surfels(spark, sf_dir), "element_id", 0.0813, 50, F.expr(_ORDER))


@register("plane_ransac", "flight_id:i hyp:i inliers:i nx:4 ny:4 nz:4 d:4", "SELECT * FROM h_best")
def _ransac(spark, sf_dir):
    return plane.anew(spark, sf_dir)


@v.derived("arch_plane")
def arch(spark, sf_dir):
    return pl.architectural_plane(v.surfels(spark, sf_dir), _NEAR, shuffle=F.expr(_ORDER))


cte("a_arch", "SELECT * FROM v_surfels WHERE semantic_class IN ('facade', 'roof', 'building')")
cte("a_draw", f"SELECT flight_id, element_id, x, y, z, row_number() OVER (PARTITION BY flight_id ORDER BY {_ORDER}, element_id) - 1 AS k FROM a_arch QUALIFY k < 600")
cte("a_hyp", """
SELECT flight_id, hyp, nx/n AS nx, ny/n AS ny, nz/n AS nz, -(nx*x0 + ny*y0 + nz*z0)/n AS d FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS n FROM (
SELECT a.flight_id, a.k // 3 AS hyp, a.x AS x0, a.y AS y0, a.z AS z0, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz
FROM a_draw a JOIN a_draw b ON b.flight_id = a.flight_id AND b.k = a.k + 1 JOIN a_draw c ON c.flight_id = a.flight_id AND c.k = a.k + 2 WHERE a.k % 3 = 0)) WHERE n >= 1e-6""")
cte("a_fit", """
SELECT h.* FROM (SELECT h.flight_id, h.hyp, count(*) AS inliers FROM a_arch s JOIN a_hyp h USING (flight_id) WHERE abs(h.nx*x + h.ny*y + h.nz*z + d) < 0.0613 GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY h.flight_id ORDER BY count(*) DESC, h.hyp) = 1) b JOIN a_hyp h ON h.flight_id = b.flight_id AND h.hyp = b.hyp WHERE inliers >= 40""", once=True)
cte("a_plane", """
SELECT flight_id, nx AS fx, ny AS fy, nz AS fz, d AS fd, abs(nz) < 0.4 AS facade, CASE WHEN abs(nz) < 0.4 THEN nx/flat ELSE nx END AS px, CASE WHEN abs(nz) < 0.4 THEN ny/flat ELSE ny END AS py, CASE WHEN abs(nz) < 0.4 THEN 0 ELSE nz END AS pz,
  CASE WHEN abs(nz) < 0.4 THEN -(nx/flat*cx + ny/flat*cy) ELSE d END AS pd
FROM (SELECT f.*, greatest(1e-6, sqrt(f.nx*f.nx + f.ny*f.ny)) AS flat, cx, cy FROM a_fit f JOIN (
SELECT s.flight_id, avg(x) AS cx, avg(y) AS cy FROM a_arch s JOIN a_fit f USING (flight_id) WHERE abs(f.nx*x + f.ny*y + f.nz*z + d) < 0.0613 GROUP BY 1) c ON c.flight_id = f.flight_id)""", once=True)
cte("a_moved", """
SELECT * REPLACE (CASE WHEN on_plane THEN x - px*off*0.5 ELSE x END AS x, CASE WHEN on_plane THEN y - py*off*0.5 ELSE y END AS y, CASE WHEN on_plane THEN z - pz*off*0.5 ELSE z END AS z) FROM (
SELECT s.*, px*x + py*y + pz*z + pd AS off, coalesce(semantic_class IN ('facade', 'roof', 'building') AND abs(fx*x + fy*y + fz*z + fd) < 0.0613, false) AS on_plane, px, py, pz, pd, fx, fy, fz, fd, facade FROM v_surfels s LEFT JOIN a_plane p ON p.flight_id = s.flight_id)""", once=True)


@register("plane_regularize", "flight_id:i element_id:i x:4 y:4 z:4 on_plane:b", "SELECT * FROM a_moved")
def _regularize(spark, sf_dir):
    return pl.plane_regularize(v.surfels(spark, sf_dir), arch(spark, sf_dir), _NEAR)


cte("g_axes", """
SELECT *, py*0 - pz*uy AS vx, pz*ux - px*0 AS vy, px*uy - py*ux AS vz FROM (SELECT *, CASE WHEN flat < 1e-4 THEN 1 ELSE py/flat END AS ux, CASE WHEN flat < 1e-4 THEN 0 ELSE -px/flat END AS uy FROM (SELECT *, sqrt(px*px + py*py) AS flat FROM a_plane))""")
cte("g_box", """
SELECT *, greatest(0, ceil((u1 - u0) / (0.08 * 1.5::DOUBLE) - 1e-9)) AS nu, greatest(0, ceil((v1 - v0) / (0.08 * 1.5::DOUBLE) - 1e-9)) AS nv FROM (
SELECT a.flight_id, min(ux*x + uy*y) AS u0, max(ux*x + uy*y) AS u1, min(vx*x + vy*y + vz*z) AS v0, max(vx*x + vy*y + vz*z) AS v1, any_value(ux) AS ux, any_value(uy) AS uy, any_value(vx) AS vx, any_value(vy) AS vy, any_value(vz) AS vz,
  any_value(a.px) AS px, any_value(a.py) AS py, any_value(a.pz) AS pz, any_value(a.pd) AS pd, any_value(a.facade) AS facade
FROM g_axes a JOIN a_moved m ON m.flight_id = a.flight_id WHERE semantic_class IN ('facade', 'roof', 'building') AND abs(a.fx*x + a.fy*y + a.fz*z + a.fd) < 0.0613 GROUP BY 1)""")
cte("g_cell", """
SELECT flight_id, iu * CAST(nv AS BIGINT) + iv AS cell, facade, (u0 + iu*0.12::DOUBLE)*ux + (v0 + iv*0.12::DOUBLE)*vx - pd*px AS x, (u0 + iu*0.12::DOUBLE)*uy + (v0 + iv*0.12::DOUBLE)*vy - pd*py AS y, (v0 + iv*0.12::DOUBLE)*vz - pd*pz AS z
FROM (SELECT *, unnest(range(CAST(nv AS BIGINT))) AS iv FROM (SELECT *, unnest(range(CAST(nu AS BIGINT))) AS iu FROM g_box))""", once=True)


@register("plane_gap_fill", "flight_id:i cell:i x:4 y:4 z:4 semantic_class:s provenance:s", """
SELECT c.flight_id, cell, any_value(c.x) AS x, any_value(c.y) AS y, any_value(c.z) AS z, CASE WHEN any_value(c.facade) THEN 'facade' ELSE 'roof' END AS semantic_class, 'STRUCTURAL_INFERRED' AS provenance
FROM g_cell c JOIN a_moved m ON m.flight_id = c.flight_id AND m.state <> 'REJECTED' GROUP BY 1, 2 HAVING sqrt(min((c.x-m.x)**2 + (c.y-m.y)**2 + (c.z-m.z)**2)) > 0.0813 AND sqrt(min((c.x-m.x)**2 + (c.y-m.y)**2 + (c.z-m.z)**2)) <= 1.5""")
def _gap_fill(spark, sf_dir):
    planes = arch(spark, sf_dir)
    moved = checkpointed(pl.plane_regularize(v.surfels(spark, sf_dir), planes, _NEAR).drop("on_plane"))
    return pl.plane_gap_fill(moved, planes, 0.08, _NEAR, near=0.0813)


cte("w_cand", """
SELECT *, x + CASE WHEN sqrt(nx*nx) < 1e-4 THEN 0.096 ELSE 0 END AS px, y + CASE WHEN sqrt(nx*nx) < 1e-4 THEN 0 ELSE -0.096 END AS py FROM (
SELECT * FROM v_surfels WHERE confidence_level = 'LOW')""")


@register("boundary_candidates", "flight_id:i element_id:i x:5 y:5 z:5 provenance:s", """
SELECT flight_id, element_id, px AS x, py AS y, z, 'GENERATIVE_INFERRED' AS provenance FROM w_cand""")
def _boundary(spark, sf_dir):
    # No camera comes within a metre of these surfels, so none of the candidates is refuted.
    return pl.boundary_candidates(v.surfels(spark, sf_dir), v.proxy_cams(spark, sf_dir), 0.08)


cte("l_rot", """
SELECT flight_id, CASE WHEN t THEN 1 - b*b*k ELSE 1 END AS r00, CASE WHEN t THEN a*b*k ELSE 0 END AS r01, CASE WHEN t THEN b ELSE 0 END AS r02, CASE WHEN t THEN 1 - a*a*k ELSE 1 END AS r11, CASE WHEN t THEN -a ELSE 0 END AS r12, CASE WHEN t THEN 1 - (a*a+b*b)*k ELSE 1 END AS r22
FROM (SELECT *, (1 - c) / CASE WHEN a*a + b*b > 0 THEN a*a + b*b ELSE 1 END AS k, c >= 0.5 AND a*a + b*b >= 1e-18 AS t FROM (
SELECT flight_id, ny * sg AS a, -nx * sg AS b, nz * sg AS c FROM (SELECT *, CASE WHEN nz < 0 THEN -1 ELSE 1 END AS sg FROM h_best WHERE inliers >= 100)))""")
cte("l_moved", "SELECT s.flight_id, element_id, r00 IS NOT NULL AS known, x, y, z, r00*x + r01*y + r02*z AS mx, r01*x + r11*y + r12*z AS my, -r02*x - r12*y + r22*z AS mz FROM v_surfels s LEFT JOIN l_rot USING (flight_id)")


@register("ground_align", "flight_id:i element_id:i x:3 y:3 z:3", """
SELECT flight_id, element_id, CASE WHEN known THEN mx - cx ELSE x END AS x, CASE WHEN known THEN my - cy ELSE y END AS y, CASE WHEN known THEN mz - z0 ELSE z END AS z FROM l_moved
JOIN (SELECT flight_id, avg(mx) AS cx, avg(my) AS cy, quantile_cont(mz, 0.01) AS z0 FROM l_moved GROUP BY 1) USING (flight_id)""")
def _ground(spark, sf_dir):
    return pl.ground_align(v.surfels(spark, sf_dir), plane(spark, sf_dir), "element_id")
