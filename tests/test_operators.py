"""Known answers, readers on real files, and order independence."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightspark.functions import geodesy
from flightspark.operators import evidence, frames, grid, jobs, mesh, raster, timeseries as ts, world
from flightspark.sources import telemetry as src

SRT = "{n}\n00:00:0{n},500 --> 00:00:0{n},900\n[iso: 100] [latitude: {lat:.6f}] [longitude: -122.4194] [rel_alt: 14.0] [abs_alt: {alt:.1f}] [yaw: 3.0]"


@pytest.mark.parametrize("gap", ["\n\n", "\n  \n", "\r\n\r\n"])
def test_srt_file(spark, tmp_path, gap):
    text = gap.join(SRT.format(n=n, lat=0.0 if n == 2 else 37.7749 + n * 1e-5, alt=50 + n) for n in range(5))
    if "\r" in gap:
        text = text.replace("\r\n", "\n").replace("\n", "\r\n")
    text = text.replace("longitude: -122.4194", "longitude: 0.0", 3).replace("longitude: 0.0", "longitude: -122.4194", 2)
    (tmp_path / "a.srt").write_text(text, newline="")
    got = src.read_srt(spark, str(tmp_path / "a.srt")).orderBy("rec_no").collect()
    assert [round(r.ts, 3) for r in got] == [0.5, 1.5, 3.5, 4.5]
    assert [r.alt for r in got] == [50.0, 51.0, 53.0, 54.0] and got[0].yaw == 3.0
    assert len({r.rec_no for r in got}) == 4


def test_csv_file(spark, tmp_path):
    head = "Timpstemp, imgid,lat,lon,alt,eph_m,epv_m\n"
    rows = "".join(f"{7_009_129 + 33_333 * i},{i + 1},473843570,85451780,{460 + i},2.0,{'' if i % 2 else '1e-30'}\n" for i in range(6))
    (tmp_path / "log.csv").write_text(head + rows)
    got = src.read_telemetry_csv(spark, str(tmp_path / "log.csv")).orderBy("rec_no").collect()
    assert len(got) == 6 and abs(got[0].ts - 7.009129) < 1e-9 and abs(got[0].lat - 47.384357) < 1e-9
    assert abs(got[1].ts - got[0].ts - 0.033333) < 1e-9 and all(abs(r.vunc - 3.2) < 1e-9 for r in got)


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"lat": 1, "lon": 2}, {"latitude": 3.5, "uncertainty": 4}]')
    (tmp_path / "b.json").write_text('{"telemetry": [{"lat": 5}]}')
    got = sorted((r.lat, r.lon, r.unc) for r in src.read_telemetry_json(spark, str(tmp_path)).collect())
    assert got == [(1.0, 2.0, 1.0), (3.5, 0.0, 4.0), (5.0, 0.0, 1.0)]


def test_geodetic_round_trip(spark):
    places = [(47.384357, 8.545178, 464.9), (28.613939, 77.209021, 216.0), (34.052235, -118.243683, 85.0)]
    d = spark.createDataFrame(places, "lat double, lon double, alt double")
    back = geodesy.ecef_to_geodetic(*geodesy.geodetic_to_ecef("lat", "lon", "alt"))
    for r in d.select("*", *[c.alias(n) for c, n in zip(back, ("a", "b", "c"))]).collect():
        assert abs(r.lat - r.a) < 1e-5 and abs(r.lon - r.b) < 1e-5 and abs(r.alt - r.c) < 0.01


def test_microsecond_clock(spark):
    d = spark.createDataFrame([(0, i, 7_009_129.0 + 33_333 * i) for i in range(20)], "flight_id long, rec_no long, raw_ts double")
    assert ts.clock_divisors(d).first().divisor == 1e6


def test_mission_flight_centre(spark):
    pts = [(0, i, 37.7749 + 1e-5 * i, -122.4194, 14.0 + i) for i in range(30)]
    r = jobs.mission_flight(spark.createDataFrame(pts, "flight_id long, rec_no long, lat double, lng double, altitude double")).first()
    assert (r.altitude, r.points, r.duration) == (14.0, 30, 45.0) and abs(r.lat - 37.775045) < 1e-9


def test_semantics_of_road_car_and_roof(spark):
    rows = [(1, 0.0, 50.0, 50.0, 50.0, 3, 0.8), (2, 0.8, 220.0, 30.0, 30.0, 1, 3.2), (3, 8.0, 180.0, 80.0, 50.0, 4, 0.9)]
    d = spark.createDataFrame(rows, "element_id long, z double, r double, g double, b double, observation_count int, reprojection_error double").selectExpr(
        "0L AS flight_id", "*", "0D AS x", "0D AS y", "1D AS nz", "0D AS dynamic_probability", "'unknown' AS semantic_class", "'ACTIVE' AS state")
    got = {r.element_id: r for r in evidence.classify_semantics(d).collect()}
    assert (got[1].semantic_class, got[1].state) == ("road", "ACTIVE")
    assert (got[2].semantic_class, got[2].state) == ("vehicle", "REJECTED") and got[2].dynamic_probability >= 0.8
    assert got[3].semantic_class == "roof"


def test_windows_of_twenty(spark):
    d = frames.make_windows(spark.createDataFrame([(0, i) for i in range(20)], "flight_id long, frame_id long"), 10, 4)
    got = {}
    for r in d.collect():
        got.setdefault(r.window_id, []).append(r.frame_id)
    assert {w: (min(f), max(f)) for w, f in got.items()} == {0: (0, 9), 1: (6, 15), 2: (12, 19)}
    assert d.filter("in_previous").groupBy("window_id").count().filter("count = 4").count() == 2


def test_keyframes_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, float(rng.random()), *np.eye(3).ravel().tolist(), *(float(c) for c in (i * 0.13, rng.normal(0, 0.1), 10.0))) for i in range(300)]
    cols = "flight_id long, frame_id long, blur double, " + ", ".join(f"{n} double" for n in frames._POSE)
    d = spark.createDataFrame(rows, cols)
    d = d.withColumns({c: F.when(F.col("frame_id") % 31 > 3, F.col(c)) for c in frames._POSE})
    one, many = ({r.frame_id for r in frames.select_keyframes(d, fold_rows=n).collect()} for n in (1000, 60))
    assert one == many and 0 in one and 299 in one


def test_box_mesh_edges(spark):
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    f = [(0, 2 * q + k, *((a, b, c) if k == 0 else (a, c, d)), False) for q, (a, b, c, d) in enumerate(quads) for k in (0, 1)]
    r = mesh.edge_topology(spark.createDataFrame(f, "flight_id long, fid long, v0 long, v1 long, v2 long, inferred boolean")).first()
    assert (r.edges, r.boundary, r.non_manifold) == (18, 0, 0)


def test_boundary_loop_of_a_missing_triangle(spark):
    n, faces = 5, []
    vid = lambda i, j: i * n + j
    for i in range(n - 1):
        for j in range(n - 1):
            faces += [(vid(i, j), vid(i + 1, j), vid(i + 1, j + 1)), (vid(i, j), vid(i + 1, j + 1), vid(i, j + 1))]
    faces.remove((vid(1, 1), vid(2, 1), vid(2, 2)))
    f = spark.createDataFrame([(0, k, *t) for k, t in enumerate(faces)], "flight_id long, fid long, v0 long, v1 long, v2 long")
    v = spark.createDataFrame([(0, vid(i, j), i * 0.05, j * 0.05, 0.0) for i in range(n) for j in range(n)], "flight_id long, vid long, x double, y double, z double")
    got = mesh.boundary_loops(f, v, 0.02).collect()
    assert [(r.loop, r.vertices) for r in got] == [(vid(1, 1), 3)]


def test_fusion_ignores_row_order_and_chunking(spark):
    rng = np.random.default_rng(2)
    rows = [(0, int(f), *(float(c) for c in rng.random(3) * 0.3), *(float(c) for c in n), 100.0, 90.0, 80.0, float(0.3 + 0.6 * rng.random()))
            for f in range(25) for n in rng.choice([(0, 0, 1), (1, 0, 0)], size=12)]
    cols = "flight_id long, frame_id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double, conf double"
    outs = []
    for order, fold in ((rows, 1000), (rows[::-1], 4)):
        obs = grid.cell_aggregate(spark.createDataFrame(order, cols), 0.08)
        outs.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in world.fuse_surfels(obs, 0.08, fold_rows=fold).select(
            "sx", "sy", "sz", "sbin", "sround", "observation_count", "x", "nx", "score", "provenance").collect()))
        assert sum(r[5] for r in outs[-1]) == obs.count()
    assert outs[0] == outs[1]


def test_nearest_far_apart_and_copies(spark):
    t = spark.createDataFrame([(0, 9, 1.0, 0.0, 0.0), (0, 4, 1.0, 0.0, 0.0), (0, 7, 500.0, 0.0, 0.0)], "flight_id long, t_id long, x double, y double, z double")
    q = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, -900.0, 3.0, 0.0), (0, 3, 499.0, 0.0, 0.0)], "flight_id long, q_id long, x double, y double, z double")
    got = {r.q_id: (r.t_id, round(r.distance, 6)) for r in grid.nearest_neighbor(q, t, "q_id", "t_id", 0.5).collect()}
    assert got == {1: (4, 1.0), 2: (4, round(math.hypot(901, 3), 6)), 3: (7, 1.0)}


def test_ellipse_rows():
    rows = {}
    for dy, _ in raster.ellipse(5):
        rows[dy] = rows.get(dy, 0) + 1
    assert rows == {-2: 1, -1: 5, 0: 5, 1: 5, 2: 1}


def test_telemetry_with_a_standing_clock_has_no_velocity_and_is_no_predecessor():
    import numpy as np
    import pandas as pd

    from flightspark.streaming.streams import _local_track

    state, out = None, []
    rows = pd.DataFrame({"rec_no": [0, 1, 2, 3, 4], "t": [0.0, 1.0, 2.0, 1.5, 3.0], "lat": 47.0 + np.array([0, 1, 2, 1.5, 3]) * 1e-5, "lon": 8.0, "alt": 100.0})
    for part in (rows[:2], rows[2:3], rows[3:4], rows[4:]):
        got, state = _local_track((1,), part, state)
        out.append(got)
    v = pd.concat(out)["vy"].to_numpy()
    assert np.isnan(v[3]) and v[0] == 0 and np.allclose(v[[1, 2, 4]], v[1]) and v[1] > 1
