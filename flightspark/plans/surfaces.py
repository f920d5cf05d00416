"""Queries over meshes and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightspark.operators import mesh as ms
from flightspark.operators import raster as ra
from flightspark.operators.scale import dealt
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register

# --- mesh: quads of a 65 x 65 lattice, two faces each ----------------------------------------------------------------------

_QUAD = "CAST(floor(l_orderkey / 1500) AS BIGINT) AS flight_id, l_partkey % 64 AS i, (l_orderkey * 13 + l_linenumber * 29) % 64 AS j"


@v.derived("mesh_faces")
def faces(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem")
    # A strip of the lattice stays in one task, so what its faces share is merged before it is dealt out again.
    strip = lines.selectExpr(*_QUAD.split(", ")).selectExpr("*", "i div 8 AS strip")
    q = dealt(strip, lines.count(), "flight_id", "strip").distinct()
    d = q.selectExpr("*", "i * 65 + j AS a", "(i + 1) * 65 + j AS b", "(i + 1) * 65 + j + 1 AS c", "i * 65 + j + 1 AS d").withColumn("k", F.explode(F.expr("array(0L, 1L)")))
    return d.selectExpr("flight_id", "(i * 64 + j) * 2 + k AS fid", "a AS v0", "if(k = 0, b, c) AS v1", "if(k = 0, c, d) AS v2", "(i + j) % 9 = 0 AS inferred")


_Z = "(({i} * 7 + {j} * 3) % 11) * CAST(0.1 AS DOUBLE)"


@v.derived("mesh_vertices")
def vertices(spark, sf_dir):
    f = faces(spark, sf_dir).select("flight_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return f.selectExpr("flight_id", "vid", "CAST(vid div 65 AS DOUBLE) * 0.3D AS x", "CAST(vid % 65 AS DOUBLE) * 0.3D AS y",
                        _Z.format(i="(vid div 65)", j="(vid % 65)") + " AS z", "CAST(vid % 256 AS DOUBLE) AS r", "CAST(vid % 251 AS DOUBLE) AS g", "CAST(vid % 241 AS DOUBLE) AS b")


cte("q_mesh", f"SELECT DISTINCT {_QUAD} FROM lineitem")
cte("v_faces", """
SELECT flight_id, (i*64 + j)*2 + k AS fid, i, j, i*65 + j AS v0, CASE WHEN k = 0 THEN (i+1)*65 + j ELSE (i+1)*65 + j + 1 END AS v1, CASE WHEN k = 0 THEN (i+1)*65 + j + 1 ELSE i*65 + j + 1 END AS v2,
  (i + j) % 9 = 0 AS inferred FROM q_mesh, (VALUES (0), (1)) AS t(k)""")
cte("v_vertices", f"""
SELECT flight_id, vid, (vid // 65) * CAST(0.3 AS DOUBLE) AS x, (vid % 65) * CAST(0.3 AS DOUBLE) AS y, {_Z.format(i='(vid // 65)', j='(vid % 65)')} AS z, CAST(vid % 256 AS DOUBLE) AS r, CAST(vid % 251 AS DOUBLE) AS g, CAST(vid % 241 AS DOUBLE) AS b
FROM (SELECT flight_id, v0 AS vid FROM v_faces UNION SELECT flight_id, v1 FROM v_faces UNION SELECT flight_id, v2 FROM v_faces)""")
cte("v_metric", """
SELECT *, n/2 AS area, nx/n AS ux, ny/n AS uy, nz/n AS uz FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS n FROM (
SELECT f.*, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS nz,
  (a.x+b.x+c.x)/3 AS mx, (a.y+b.y+c.y)/3 AS my, (a.z+b.z+c.z)/3 AS mz,
  greatest(sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2), sqrt((c.x-b.x)**2 + (c.y-b.y)**2 + (c.z-b.z)**2), sqrt((a.x-c.x)**2 + (a.y-c.y)**2 + (a.z-c.z)**2)) AS longest
FROM v_faces f JOIN v_vertices a ON a.flight_id = f.flight_id AND a.vid = f.v0 JOIN v_vertices b ON b.flight_id = f.flight_id AND b.vid = f.v1 JOIN v_vertices c ON c.flight_id = f.flight_id AND c.vid = f.v2))""")


@v.derived("mesh_metrics")
def metrics(spark, sf_dir):
    return ms.face_metrics(faces(spark, sf_dir), vertices(spark, sf_dir))


@v.derived("mesh_shells")
def shells(spark, sf_dir):
    return ms.face_shells(faces(spark, sf_dir))


@register("face_metrics", "flight_id:i fid:i area:6 nx:5 ny:5 nz:5 mx:5 my:5 mz:5 longest:5", "SELECT flight_id, fid, area, ux AS nx, uy AS ny, uz AS nz, mx, my, mz, longest FROM v_metric")
def _face_metrics(spark, sf_dir):
    return metrics.anew(spark, sf_dir)


@register("drop_degenerate", "flight_id:i fid:i", """
SELECT flight_id, fid FROM (SELECT *, sum(CASE WHEN longest <= 0.1234 * 6 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id) AS fitting FROM v_metric WHERE area > 1e-10) WHERE longest <= 0.1234 * 6 OR fitting < 32""")
def _drop_degenerate(spark, sf_dir):
    return ms.drop_degenerate(metrics(spark, sf_dir), 0.1234)


cte("v_edges", """
SELECT flight_id, least(p, q) AS a, greatest(p, q) AS b, count(*) AS uses FROM (SELECT flight_id, v0 AS p, v1 AS q FROM v_faces UNION ALL SELECT flight_id, v1, v2 FROM v_faces UNION ALL SELECT flight_id, v2, v0 FROM v_faces) GROUP BY ALL""")


@register("edge_topology", "flight_id:i edges:i boundary:i non_manifold:i", """
SELECT flight_id, count(*) AS edges, sum(CASE WHEN uses = 1 THEN 1 ELSE 0 END) AS boundary, sum(CASE WHEN uses > 2 THEN 1 ELSE 0 END) AS non_manifold FROM v_edges GROUP BY 1""")
def _edges(spark, sf_dir):
    return ms.edge_topology(faces(spark, sf_dir))


# Shells of quads: a quad's two faces share its diagonal, and quads share edges with their four neighbours. Quads of a lattice row
# that stand side by side are one run; runs of neighbouring rows are linked where they overlap.
cte("q_run", """
SELECT flight_id, i, j, i*64 + min(j) OVER (PARTITION BY flight_id, i, g) AS r FROM (SELECT *, j - row_number() OVER (PARTITION BY flight_id, i ORDER BY j) AS g FROM q_mesh)""")
cte("q_pairs", """
SELECT DISTINCT a.flight_id, unnest([a.r, b.r]) AS p, unnest([b.r, a.r]) AS q FROM q_run a JOIN q_run b ON a.flight_id = b.flight_id AND b.i = a.i + 1 AND b.j = a.j""")
cte("q_walk", """
SELECT DISTINCT flight_id, r AS q, r AS s FROM q_run UNION SELECT w.flight_id, p.q, w.s FROM q_walk w JOIN q_pairs p ON p.flight_id = w.flight_id AND p.p = w.q""")
cte("q_shell", """
SELECT q_run.flight_id, i*64 + j AS q, s FROM q_run JOIN (SELECT flight_id, q, min(s) AS s FROM q_walk GROUP BY 1, 2) m ON m.flight_id = q_run.flight_id AND m.q = q_run.r""")
cte("v_shell", "SELECT m.*, s.s * 2 AS shell FROM v_metric m JOIN q_shell s ON s.flight_id = m.flight_id AND s.q = m.i*64 + m.j")
cte("v_comp", "SELECT flight_id, shell, count(*) AS faces, sum(area) AS area, min(mx) AS x_min, max(mx) AS x_max, min(my) AS y_min, max(my) AS y_max, min(mz) AS z_min, max(mz) AS z_max FROM v_shell GROUP BY 1, 2")


@register("mesh_components", "flight_id:i shell:i faces:i area:5 x_min:4 x_max:4 z_max:4", "SELECT * FROM v_comp")
def _components(spark, sf_dir):
    return ms.mesh_components(metrics(spark, sf_dir), shells(spark, sf_dir))


@register("drop_fragments", "flight_id:i fid:i shell:i", """
SELECT s.flight_id, s.fid, s.shell FROM v_shell s JOIN v_comp c ON c.flight_id = s.flight_id AND c.shell = s.shell JOIN (SELECT flight_id, max(area) AS best FROM v_comp GROUP BY 1) b ON b.flight_id = s.flight_id
WHERE c.area >= least(greatest((0.151 * 6)**2, 0.25), best)""")
def _fragments(spark, sf_dir):
    return ms.drop_fragments(metrics(spark, sf_dir), shells(spark, sf_dir), 0.151)


@register("drop_islands", "flight_id:i shell:i faces:i verdict:s", """
WITH o AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(sum(faces) OVER (PARTITION BY flight_id ORDER BY faces DESC, shell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(faces) OVER (PARTITION BY flight_id) AS tot
  FROM v_comp WINDOW w AS (PARTITION BY flight_id ORDER BY faces DESC, shell)),
c AS (SELECT flight_id, min(x_min) AS x0, max(x_max) AS x1, min(y_min) AS y0, max(y_max) AS y1, min(z_min) AS z0, max(z_max) AS z1 FROM o WHERE k < 2 OR bf < 0.7 * tot GROUP BY 1),
d AS (SELECT o.*, CASE WHEN (z_min+z_max)/2 < z0 - 8 OR (z_min+z_max)/2 > z1 + 15 OR (sqrt(((x_min+x_max)/2 - (x0+x1)/2)**2 + ((y_min+y_max)/2 - (y0+y1)/2)**2) > greatest(35, 1.2 * sqrt((x1-x0)**2 + (y1-y0)**2 + (z1-z0)**2)) AND faces < 3000) THEN 'far'
  WHEN faces < 12 AND area < 0.8 THEN 'crumb' WHEN faces >= 90 OR area >= 4.01 THEN 'anchor' ELSE 'open' END AS kind FROM o JOIN c USING (flight_id))
SELECT flight_id, shell, faces, CASE WHEN kind <> 'open' THEN kind ELSE 'near' END AS verdict FROM d""")
def _islands(spark, sf_dir):
    # Every shell of this lattice lies within the 18 m that count as near.
    return ms.drop_islands(metrics(spark, sf_dir), shells(spark, sf_dir), 0.3, anchor_faces=90, anchor_area=4.01, crumb_faces=12, crumb_area=0.8)


# A ring of at most 24 vertices is walked round in twelve steps either way; a larger one shows 25 vertices by then.
cte("b_edge", "SELECT flight_id, a AS p, b AS q FROM v_edges WHERE uses = 1 UNION ALL SELECT flight_id, b, a FROM v_edges WHERE uses = 1", once=True)
cte("b_walk", """
SELECT DISTINCT flight_id, p AS s, p AS v, 0 AS k FROM b_edge UNION SELECT w.flight_id, w.s, e.q, w.k + 1 FROM b_walk w JOIN b_edge e ON e.flight_id = w.flight_id AND e.p = w.v WHERE w.k < 12""")
cte("b_ring", """
SELECT flight_id, s, v FROM (SELECT *, min(degree) OVER g AS least, max(degree) OVER g AS most, count(*) OVER g AS n, min(v) OVER g AS first FROM (SELECT DISTINCT flight_id, s, v FROM b_walk) w
JOIN (SELECT flight_id, p AS v, count(*) AS degree FROM b_edge GROUP BY 1, 2) d USING (flight_id, v) WINDOW g AS (PARTITION BY flight_id, s)) WHERE least = 2 AND most = 2 AND n BETWEEN 3 AND 24 AND first = s""")
cte("b_loop", """
SELECT * FROM (SELECT r.flight_id, s AS loop, count(*) AS vertices, sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2) AS diagonal, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz
FROM b_ring r JOIN v_vertices p ON p.flight_id = r.flight_id AND p.vid = r.v GROUP BY 1, 2) WHERE diagonal <= 1.21""")


@register("boundary_loops", "flight_id:i loop:i vertices:i diagonal:5 cx:4 cy:4 cz:4", "SELECT * FROM b_loop")
def _loops(spark, sf_dir):
    # Six voxels of this size are no diagonal of the lattice.
    return ms.boundary_loops(faces(spark, sf_dir), vertices(spark, sf_dir), 1.21 / 6)


@register("close_loops", "flight_id:i loop:i v0:i v1:i v2:i", """
WITH side AS (SELECT flight_id, v0 AS p, v1 AS q FROM v_faces UNION ALL SELECT flight_id, v1, v2 FROM v_faces UNION ALL SELECT flight_id, v2, v0 FROM v_faces)
SELECT l.flight_id, loop, q AS v0, p AS v1, -1 - loop AS v2 FROM b_loop l JOIN b_ring r ON r.flight_id = l.flight_id AND r.s = l.loop JOIN side ON side.flight_id = l.flight_id AND side.p = r.v
JOIN v_edges e ON e.flight_id = l.flight_id AND e.a = least(p, q) AND e.b = greatest(p, q) AND uses = 1 WHERE vertices > 3""")
def _close(spark, sf_dir):
    f = faces(spark, sf_dir)
    return ms.close_loops(ms.boundary_loops(f, vertices(spark, sf_dir), 1.21 / 6), f)


@register("mesh_provenance", "flight_id:i measured_faces:i inferred_faces:i measured_area_m2:4 inferred_area_m2:4 inferred_face_percent:4 inferred_area_percent:4", """
SELECT *, 100.0 * inferred_faces / (measured_faces + inferred_faces) AS inferred_face_percent, 100.0 * inferred_area_m2 / (measured_area_m2 + inferred_area_m2) AS inferred_area_percent FROM (
SELECT flight_id, sum(CASE WHEN inferred THEN 0 ELSE 1 END) AS measured_faces, sum(CASE WHEN inferred THEN 1 ELSE 0 END) AS inferred_faces, sum(CASE WHEN inferred THEN 0 ELSE area END) AS measured_area_m2, sum(CASE WHEN inferred THEN area ELSE 0 END) AS inferred_area_m2 FROM v_metric GROUP BY 1)""")
def _provenance(spark, sf_dir):
    return ms.mesh_provenance(metrics(spark, sf_dir))


@register("outlier_filter", "flight_id:i vid:i", """
SELECT flight_id, vid FROM v_vertices WHERE NOT (b > r + 20 AND b > g + 10 AND b > 120) AND x BETWEEN 1 AND 15.05 AND y BETWEEN 2 AND 18.05""")
def _outliers(spark, sf_dir):
    return ms.outlier_filter(vertices(spark, sf_dir), {"x": (1.0, 15.05), "y": (2.0, 18.05)})


# --- rasters -----------------------------------------------------------------------------------------------------------------

cte("r_grid", """
SELECT *, sx / width AS gsd_x, sy / height AS gsd_y FROM (SELECT *, least(8192, greatest(32, ceil(sx / 0.37))) AS width, least(8192, greatest(32, ceil(sy / 0.37))) AS height FROM (
SELECT flight_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, greatest(1, max(x) - min(x)) AS sx, greatest(1, max(y) - min(y)) AS sy FROM v_vertices GROUP BY 1))""")
cte("r_cell", """
SELECT v.*, least(height - 1, greatest(0, floor((y_max - y) / gsd_y))) AS row, least(width - 1, greatest(0, floor((x - x_min) / gsd_x))) AS col FROM v_vertices v JOIN r_grid USING (flight_id)""")
cte("r_dsm", "SELECT flight_id, row, col, max(z) AS z, arg_max(r, struct_pack(z, vid)) AS r, arg_max(g, struct_pack(z, vid)) AS g, arg_max(b, struct_pack(z, vid)) AS b FROM r_cell GROUP BY 1, 2, 3")


@v.derived("grid")
def grid(spark, sf_dir):
    return ra.raster_grid(vertices(spark, sf_dir), 0.37)


@v.derived("dsm")
def dsm(spark, sf_dir):
    return ra.dsm_ortho(vertices(spark, sf_dir), grid(spark, sf_dir))


@register("raster_grid", "flight_id:i width:i height:i gsd_x:6 gsd_y:6 z_max:3", "SELECT * FROM r_grid")
def _grid(spark, sf_dir):
    return grid.anew(spark, sf_dir)


@register("dsm_ortho", "flight_id:i row:i col:i z:4 r:1 g:1 b:1", "SELECT * FROM r_dsm")
def _dsm(spark, sf_dir):
    return dsm.anew(spark, sf_dir)


def _kernel(size: int) -> str:
    return "(VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx in ra.ellipse(size)) + ") AS k(dy, dx)"


cte("r_all", "SELECT flight_id, y AS row, x AS col, height, width FROM r_grid, (SELECT unnest(range(200)) AS y), (SELECT unnest(range(200)) AS x) WHERE y < height AND x < width")
cte("r_grown", f"SELECT DISTINCT flight_id, row + dy AS row, col + dx AS col FROM r_dsm, {_kernel(5)}")
cte("r_closed", f"""
SELECT a.flight_id, a.row, a.col FROM r_all a, {_kernel(5)} LEFT JOIN r_grown g ON g.flight_id = a.flight_id AND g.row = a.row + dy AND g.col = a.col + dx
WHERE a.row + dy BETWEEN 0 AND height - 1 AND a.col + dx BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3 HAVING count(*) = count(g.row)""")


def _fill_sql() -> str:
    parts = ["f0 AS (SELECT flight_id, row, col, z, r, false AS filled FROM r_dsm)", "h0 AS (SELECT * FROM r_closed EXCEPT SELECT flight_id, row, col FROM r_dsm)"]
    for k in range(4):
        parts.append(f"n{k} AS (SELECT h.flight_id, h.row, h.col, avg(f.z) AS z, avg(f.r) AS r, true AS filled FROM h{k} h JOIN f{k} f ON f.flight_id = h.flight_id AND abs(f.row - h.row) <= 1 AND abs(f.col - h.col) <= 1 GROUP BY 1, 2, 3)")
        parts.append(f"f{k + 1} AS (SELECT * FROM f{k} UNION ALL SELECT * FROM n{k})")
        parts.append(f"h{k + 1} AS (SELECT * FROM h{k} EXCEPT SELECT flight_id, row, col FROM n{k})")
    return f"WITH {', '.join(parts)} SELECT flight_id, row, col, z + 0.0000137 AS z, r + 0.0000137 AS r, filled FROM f4"


@register("raster_fill", "flight_id:i row:i col:i z:4 r:3 filled:b", _fill_sql())
def _fill(spark, sf_dir):
    return ra.raster_fill(dsm(spark, sf_dir), grid(spark, sf_dir)).withColumns({"z": F.col("z") + 0.0000137, "r": F.col("r") + 0.0000137})


cte("r_q", "SELECT d.*, floor(least(1, greatest(0, (z - z_min) / greatest(1e-4, z_max - z_min))) * 255) AS q FROM r_dsm d JOIN r_grid USING (flight_id)")
cte("r_eroded", f"""
SELECT a.flight_id, a.row, a.col, min(coalesce(q.q, 0)) AS e FROM r_all a, {_kernel(15)} LEFT JOIN r_q q ON q.flight_id = a.flight_id AND q.row = a.row + dy AND q.col = a.col + dx
WHERE a.row + dy BETWEEN 0 AND height - 1 AND a.col + dx BETWEEN 0 AND width - 1 GROUP BY 1, 2, 3""")


@register("dtm", "flight_id:i row:i col:i z:4", f"""
SELECT d.flight_id, d.row, d.col, least(d.z, o / 255 * (z_max - z_min) + z_min + 0.3) AS z FROM r_dsm d JOIN r_grid USING (flight_id)
JOIN (SELECT a.flight_id, a.row, a.col, max(e.e) AS o FROM r_dsm a, {_kernel(15)} JOIN r_eroded e ON e.flight_id = a.flight_id AND e.row = a.row + dy AND e.col = a.col + dx GROUP BY 1, 2, 3) x
ON x.flight_id = d.flight_id AND x.row = d.row AND x.col = d.col""")
def _dtm(spark, sf_dir):
    return ra.dtm(dsm(spark, sf_dir), grid(spark, sf_dir))


@register("building_footprint", "flight_id:i points:i x0:4 x1:4 y0:4 y1:4 height_m:4 area_m2:4", """
SELECT s.flight_id, count(*) AS points, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(z) - any_value(zg) AS height_m, (max(x) - min(x)) * (max(y) - min(y)) AS area_m2
FROM v_surfels s JOIN (SELECT flight_id, quantile_cont(z, 0.12) AS zg FROM v_surfels GROUP BY 1) g ON g.flight_id = s.flight_id WHERE z > zg + 2.5 GROUP BY 1 HAVING count(*) >= 30""")
def _footprint(spark, sf_dir):
    return ra.building_footprint(v.surfels(spark, sf_dir))


@register("measurements", "flight_id:i footprint_m2:3 volume_m3:3 gsd:6 height_z:4 surface_m2:3", """
SELECT g.flight_id, footprint_m2, volume_m3, (gsd_x + gsd_y) / 2 AS gsd, z_max - z_min AS height_z, surface_m2 FROM r_grid g
JOIN (SELECT d.flight_id, count(*) * any_value(gsd_x * gsd_y) AS footprint_m2, sum(greatest(0, z - zd)) * any_value(gsd_x * gsd_y) AS volume_m3 FROM r_dsm d JOIN r_grid r ON r.flight_id = d.flight_id
  JOIN (SELECT flight_id, quantile_cont(z, 0.12) AS zd FROM v_vertices GROUP BY 1) q ON q.flight_id = d.flight_id GROUP BY 1) m ON m.flight_id = g.flight_id
JOIN (SELECT flight_id, sum(area) AS surface_m2 FROM v_metric GROUP BY 1) a ON a.flight_id = g.flight_id""")
def _measure(spark, sf_dir):
    return ra.measurements(dsm(spark, sf_dir), grid(spark, sf_dir), vertices(spark, sf_dir), metrics(spark, sf_dir))


@register("world_file", "flight_id:i text:s", """
SELECT flight_id, format('{:.8f}', gsd_x) || chr(10) || '0.00000000' || chr(10) || '0.00000000' || chr(10) || format('{:.8f}', -gsd_y) || chr(10) || format('{:.8f}', x_min + gsd_x * 0.5) || chr(10) || format('{:.8f}', y_max - gsd_y * 0.5) AS text FROM r_grid""")
def _world_file(spark, sf_dir):
    return ra.world_file(grid(spark, sf_dir))
