"""Rasters and mesh layouts on small tables."""

from flightspark.operators import raster


def test_a_hole_that_no_ring_reaches_stays_open(spark):
    filled = [(2, 9), (4, 8), (5, 0), (5, 10), (7, 11), (8, 3), (11, 9)]
    cells = spark.createDataFrame([(1, r, c, 5.0, 1.0, 2.0, 3.0) for r, c in filled], "flight_id long, row long, col long, z double, r double, g double, b double")
    grid = spark.createDataFrame([(1, 12, 12)], "flight_id long, width long, height long")
    closed = {(r["row"], r["col"]) for r in raster.close_mask(cells, grid).collect()}
    got = {(r["row"], r["col"]): r for r in raster.raster_fill(cells, grid).collect()}
    assert (11, 11) in closed and (11, 11) not in got
    assert all(got[c]["z"] == 5.0 for c in got) and {c for c in got if not got[c]["filled"]} == set(filled)
    assert set(got) - set(filled) <= closed


def test_cells_of_an_atlas_are_disjoint_and_fill_page_after_page(spark):
    from flightspark.operators import atlas

    faces = [(f, k * 3, 0.08 if k % 2 else 0.02) for f, n in ((1, 50), (2, 7), (3, 1)) for k in range(n)]
    m = spark.createDataFrame(faces, "flight_id long, fid long, area double").repartition(5)
    gsd = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 100.0)], "flight_id long, gsd double")
    for max_px, pages in ((8192, 1), (20, 4)):
        rows = atlas.atlas_layout(m, gsd, max_px).collect()
        by = {}
        for r in rows:
            by.setdefault(r["flight_id"], []).append(r)
        assert {f: len(v) for f, v in by.items()} == {1: 50, 2: 7, 3: 1}
        for own in by.values():
            own.sort(key=lambda r: r["fid"])
            order = [(r["page"], r["y"], r["x"]) for r in own]
            assert order == sorted(order) and len(set(order)) == len(order)
            step = own[0]["cell"] + atlas.PAD
            assert all((r["x"] - 1) % step == 0 and r["x"] + r["cell"] < r["side"] and r["y"] + r["cell"] < r["side"] for r in own)
            assert own[0]["side"] <= max(max_px, step)
        assert len({r["page"] for r in by[1]}) == pages
        assert {f: own[0]["cell"] for f, own in by.items()} == {1: 3, 2: 2, 3: 2}


def test_farthest_views_of_orbits_and_clouds(spark):
    import math
    import random
    import time

    from flightspark.operators import tracks

    rng = random.Random(8)
    turn = [(math.cos(k * 2 * math.pi / 20_001), math.sin(k * 2 * math.pi / 20_001)) for k in range(20_001)]
    keys = {1: [(30 * c, 30 * s, 10.0) for c, s in turn], 2: [(rng.gauss(0, 5), rng.gauss(0, 5), rng.gauss(0, 1)) for _ in range(400)],
            3: [(1.0, 2.0, 3.0)] * 5, 4: [(float(k % 7), 0.0, 0.0) for k in range(60)], 5: [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]}
    rows = [(1, k, i, *p) for k, ps in keys.items() for i, p in enumerate(ps)]
    d = spark.createDataFrame(rows, "flight_id long, track_id long, frame_id long, tx double, ty double, tz double").repartition(4)
    start = time.time()
    got = {r["track_id"]: (r["frame_id"], r["frame_id_2"], r["distance"]) for r in tracks.farthest_pairs(d, ["flight_id", "track_id"], ("tx", "ty", "tz"), "frame_id").collect()}
    assert time.time() - start < 120
    for k in (2, 4, 5):
        ps = keys[k]
        dist, a, b = max((round(math.dist(ps[a], ps[b]), 9), -a, -b) for a in range(len(ps)) for b in range(a + 1, len(ps)))
        assert (round(got[k][2], 9), -got[k][0], -got[k][1]) == (dist, a, b)
    assert 3 not in got
    # An odd number of places: the farthest are half a step from being opposite.
    assert abs(got[1][2] - 60 * math.cos(math.pi / 40_002)) < 1e-9 and got[1][1] - got[1][0] in (10_000, 10_001)


def test_depth_range_with_landmarks_on_all_sides(spark):
    import random

    import numpy as np

    from flightspark.operators import frames

    rng = random.Random(3)
    points = [(f, rng.uniform(-9, 9), rng.choice([rng.uniform(-9, 9), 1.5]), rng.gauss(0, 4)) for f, n in ((1, 900), (2, 25), (3, 12)) for _ in range(n)]
    points += [(1, None, 0.0, 0.0)]
    poses = []
    for f in (1, 2, 3, 4):
        for k in range(12):
            axis = np.array([rng.gauss(0, 1) for _ in range(3)])
            axis /= np.linalg.norm(axis)
            poses.append((f, k, *map(float, axis), *[rng.uniform(-4, 4) for _ in range(3)]))
    got = {(r["flight_id"], r["frame_id"]): (r["lo"], r["hi"]) for r in frames.depth_range(
        spark.createDataFrame(points, "flight_id long, x double, y double, z double"),
        spark.createDataFrame(poses, "flight_id long, frame_id long, r02 double, r12 double, r22 double, tx double, ty double, tz double")).collect()}
    for f, k, *p in poses:
        own = np.array([q[1:] for q in points if q[0] == f and q[1] is not None]).reshape(-1, 3)
        z = (own - p[3:]) @ np.array(p[:3])
        z = z[z > 0.2]
        lo, hi = 1.0, 100.0
        if len(z) >= 20:
            p2, p98 = np.percentile(1 / z, [2, 98])
            if p98 * 1.15 > p2 * 0.85 > 1e-6:
                lo, hi = 1 / (p98 * 1.15), 1 / (p2 * 0.85)
        lo = 1.0 if lo <= 0.1 else lo
        hi = max(lo * 3, 100.0) if hi <= lo * 1.05 else hi
        if f == 4:  # no landmark at all: no row is asked of the flight
            continue
        assert got[f, k] == (np.float64(lo), np.float64(hi)) or np.allclose(got[f, k], (lo, hi), rtol=1e-9)


def test_tasks_of_a_mesh_follow_its_rows(spark, monkeypatch):
    from flightspark.operators import mesh, scale
    from flightspark.session import checkpointed

    monkeypatch.setattr(scale, "ROWS", 20, raising=False)
    corners = [(1, k, float(k % 20), float(k // 20), float(k % 3)) for k in range(220)]
    tri = [(1, k, k, k + 1, k + 20) for k in range(199)]
    vertices = checkpointed(spark.createDataFrame(corners, "flight_id long, vid long, x double, y double, z double"))
    faces = checkpointed(spark.createDataFrame([(*t, False) for t in tri], "flight_id long, fid long, v0 long, v1 long, v2 long, inferred boolean"))
    m = mesh.face_metrics(faces, vertices)
    assert m.rdd.getNumPartitions() == 10  # the session has four
    assert {r["fid"] for r in m.collect()} == set(range(199))


def test_ground_of_cells_at_the_border_is_compiled_and_right(spark):
    import random

    rng = random.Random(4)
    height, width = 21, 33
    z = {(r, c): float(rng.randint(0, 9)) for r in range(height) for c in range(width) if rng.random() < 0.97}
    cells = spark.createDataFrame([(1, r, c, v, 0.0, 0.0, 0.0) for (r, c), v in z.items()], "flight_id long, row long, col long, z double, r double, g double, b double")
    grid = spark.createDataFrame([(1, width, height, 0.0, 9.0)], "flight_id long, width long, height long, z_min double, z_max double")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {(r["row"], r["col"]): r["z"] for size in (5, 15) for r in raster.dtm(cells, grid, size).withColumn("row", raster.F.col("row") + 100 * size).collect()}
        closed = {(r["row"], r["col"]) for r in raster.close_mask(cells, grid).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    on = lambda r, c: 0 <= r < height and 0 <= c < width
    for size in (5, 15):
        k = raster.ellipse(size)
        step = {p: int(min(1.0, max(0.0, v / 9)) * 255) for p, v in z.items()}
        low = {(r, c): min(step.get((r + a, c + b), 0) for a, b in k if on(r + a, c + b)) for r in range(height) for c in range(width)}
        for (r, c), v in z.items():
            up = max(low[r + a, c + b] for a, b in k if on(r + a, c + b))
            assert abs(got[r + 100 * size, c] - min(v, up / 255 * 9 + 0.3)) < 1e-9
    grown = {(r + a, c + b) for r, c in z for a, b in raster.ellipse(5)}
    assert closed == {(r, c) for r in range(height) for c in range(width) if all((r + a, c + b) in grown for a, b in raster.ellipse(5) if on(r + a, c + b))}


def test_a_round_of_holes_reads_only_what_the_round_before_filled(spark, monkeypatch):
    from pathlib import Path

    read = []

    def noted(df):
        if "filled" in df.columns:
            read.append({Path(f).parent for f in df.inputFiles()})
        return kept(df)

    kept = raster.checkpointed
    monkeypatch.setattr(raster, "checkpointed", noted)
    side = 12
    filled = [(r, c) for r in range(side) for c in range(side) if r in (0, side - 1) or c in (0, 4, 8, side - 1)]
    cells = spark.createDataFrame([(1, r, c, float(r + c), 1.0, 2.0, 3.0) for r, c in filled] + [(1, 0, 0, 6.0, 1.0, 2.0, 3.0)], "flight_id long, row long, col long, z double, r double, g double, b double")
    grid = spark.createDataFrame([(1, side, side)], "flight_id long, width long, height long")
    got = {(r["row"], r["col"]): r["z"] for r in raster.raster_fill(cells, grid).filter("filled").collect()}
    have = [((r, c), float(r + c)) for r, c in filled] + [((0, 0), 6.0)]
    holes, want = {(r["row"], r["col"]) for r in raster.close_mask(cells, grid).collect()} - set(filled), {}
    while True:
        new = {h: [v for p, v in have if max(abs(p[0] - h[0]), abs(p[1] - h[1])) == 1] for h in holes}
        new = {h: sum(v) / len(v) for h, v in new.items() if v}
        if not new:
            break
        have, holes, want = have + list(new.items()), holes - set(new), want | new
    assert want.keys() == got.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want)
    assert len(read) > 3 and all(len(folders) <= 2 for folders in read)
