"""The shared ordering kit against plain Python, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightspark.operators import scale


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 6), i, float(rnd.randrange(50))) for i in range(900)]
    rnd.shuffle(out)
    return out


def _df(spark, rows):
    return spark.createDataFrame(rows, "k long, i long, v double")


def test_previous_rank_and_running_sum(spark, rows):
    ch = scale.range_chunks(_df(spark, rows), "k", "i", 5)
    d = scale.with_running_sum(scale.with_rank(scale.with_previous(ch, "k", "i", ["v"]), "k", "i"), "k", "i", "v", "s")
    got = {(r.k, r.i): (r.prev_v, r["rank"], r.s) for r in d.collect()}
    for k in {r[0] for r in rows}:
        last, n, s = None, 0, 0.0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            assert got[(k, i)] == (last, n, s)
            last, n, s = v, n + 1, s + v


def test_brackets(spark, rows):
    d = _df(spark, rows).withColumn("x", F.when(F.col("i") % 7 == 0, F.struct("i")))
    got = {(r.k, r.i): (r._before and r._before.i, r._after and r._after.i) for r in scale.with_brackets(scale.range_chunks(d, "k", "i", 5), "k", "i", "x").collect()}
    for k in {r[0] for r in rows}:
        ids = sorted(r[1] for r in rows if r[0] == k)
        known = [i for i in ids if i % 7 == 0]
        for i in ids:
            before, after = [j for j in known if j <= i], [j for j in known if j >= i]
            assert got[(k, i)] == (before[-1] if before else None, after[0] if after else None)


def test_exact_quantiles(spark, rows):
    got = {r.k: (r.lo, r.med, r.hi) for r in scale.exact_quantiles(_df(spark, rows), "k", "v", {"lo": 0.02, "med": 0.5, "hi": 0.95}).collect()}
    for k in {r[0] for r in rows}:
        assert np.allclose(got[k], np.quantile([r[2] for r in rows if r[0] == k], [0.02, 0.5, 0.95]))


def test_components_hub_chain_and_cycle(spark):
    edges = [(0, 0, i) for i in range(1, 60)] + [(0, i, i + 1) for i in range(100, 140)] + [(0, 201, 202), (0, 202, 203), (0, 203, 201), (1, 5, 5), (1, 7, 8)]
    got = {(r.g, r.node): r.component for r in scale.connected_components(spark.createDataFrame(edges, "g long, a long, b long"), ["g"], "a", "b").collect()}
    assert all(got[(0, i)] == 0 for i in range(60)) and all(got[(0, i)] == 100 for i in range(100, 141))
    assert got[(0, 203)] == 201 and got[(1, 5)] == 5 and got[(1, 8)] == 7


def _joined(edges):
    up = {(g, n): n for g, a, b in edges for n in (a, b)}
    for _ in up:
        for g, a, b in edges:
            up[g, a] = up[g, b] = min(up[g, a], up[g, b])
    return up


def test_components_over_many_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers((0, 0, 0), (3, 150, 150), (200, 3))] + [(5, i, i + 1) for i in range(1000, 1060)] + [(5, 5, 5)]
    for size in (7, 60):
        monkeypatch.setattr(scale, "PIECE", size)
        got = {(r.g, r.node): r.component for r in scale.connected_components(spark.createDataFrame(edges, "g long, a long, b long"), ["g"], "a", "b").collect()}
        assert got == _joined(edges)
    named = [(g, f"n{a}", f"n{b}") for g, a, b in edges]
    got = {(r.g, r.node): r.component for r in scale.connected_components(spark.createDataFrame(named, "g long, a string, b string"), ["g"], "a", "b").collect()}
    assert got == _joined(named)


def test_components_of_near_ids_need_no_stars(spark, monkeypatch):
    monkeypatch.setattr(scale, "PIECE", 500)
    monkeypatch.setattr(scale, "_starred", None)
    edges = [(g, i, i + 1) for g in range(4) for i in range(800) if i % 100 != 99]
    got = scale.connected_components(spark.createDataFrame(edges, "g long, a long, b long"), ["g"], "a", "b").collect()
    assert len(got) == 3200 and all(r.component == r.node - r.node % 100 for r in got)


def test_components_with_missing_ends(spark):
    edges = [(1, 1, None), (1, None, None), (None, 3, 4), (1, 2, 1), (2, None, 9)]
    got = scale.connected_components(spark.createDataFrame(edges, "g long, a long, b long"), ["g"], "a", "b").collect()
    assert {tuple(r) for r in got} == {(1, 1, 1), (1, 2, 1), (1, None, None), (None, 3, 3), (None, 4, 4), (2, None, None), (2, 9, 9)} and len(got) == 7


def _places(spark, rows, key):
    return spark.createDataFrame([(1, i, *p) for i, p in enumerate(rows)], f"flight_id long, {key} long, x double, y double, z double")


def test_radius_join_finds_places_on_cell_borders_without_a_broadcast(spark):
    from flightspark.operators.grid import nearest_neighbor, radius_join

    at = [(0.12 * i, 0.24 * j, 0.0) for i in range(-4, 5) for j in range(-2, 3)] + [(1e7 + 0.12 * i, 0.0, -0.12) for i in range(4)]
    q, t = _places(spark, at, "q_id"), _places(spark, at, "element_id")
    out = radius_join(q, t, 0.24, "q_id")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    gap = lambda p, s: sum((a - b) ** 2 for a, b in zip(p, s)) ** 0.5
    want = {(i, j) for i, p in enumerate(at) for j, s in enumerate(at) if gap(p, s) <= 0.24}
    assert {(r.q_id, r.element_id) for r in out.collect()} == want
    near = nearest_neighbor(q, t.filter("element_id % 3 = 0"), "q_id", "element_id", 0.12).collect()
    assert {r.q_id: round(r.distance, 9) for r in near} == {i: round(min(gap(p, s) for j, s in enumerate(at) if j % 3 == 0), 9) for i, p in enumerate(at)}


def test_depth_pixels_travel_once(spark):
    from flightspark.operators import depth as dp

    rows = [(f, u, v, 4.0 + (u * 3 + v) % 5 * 0.01, (u * 5 + v * 3 + f) % 13 != 0) for f in (1, 2) for u in range(9) for v in range(7) if (u, v) != (4, 4)]
    px = spark.createDataFrame([(1, *r) for r in rows], "flight_id long, frame_id long, u long, v long, depth double, mask boolean")
    opened = dp.morph_open(px)
    assert opened._jdf.queryExecution().sparkPlan().toString().count("RepartitionBy") + opened._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    on = {r[:3] for r in rows if r[4]}
    box = lambda f, u, v: {(f, a, b) for a in range(max(0, u - 1), min(8, u + 1) + 1) for b in range(max(0, v - 1), min(6, v + 1) + 1)}
    core = [r[:3] for r in rows if box(*r[:3]) <= on]
    want = {p for c in core for p in box(*c)} & {r[:3] for r in rows}
    assert {(r.frame_id, r.u, r.v) for r in opened.collect()} == want
    cams = spark.createDataFrame([(1, f, 7.5, 7.5, 4.0, 3.0) for f in (1, 2)], "flight_id long, frame_id long, fx double, fy double, cx double, cy double")
    normals = dp.depth_normals(px.select("flight_id", "frame_id", "u", "v", "depth"), cams)
    assert normals._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 2
    assert normals.count() == len(rows)


def test_observations_with_a_seed_in_their_cell_are_not_copied(spark, monkeypatch):
    from flightspark.operators import world

    copied, real = [], world.neighbours
    monkeypatch.setattr(world, "neighbours", lambda d: copied.append(d.count()) or real(d))
    obs = [(1, f, x, 0.05, 0.05, 0.0, 0.0, 1.0) for f in range(3) for x in (0.05, 0.55)] + [(1, 9, 0.09, 0.05, 0.05, 0.0, 0.0, 1.0)]
    d = spark.createDataFrame(obs, "flight_id long, frame_id long, x double, y double, z double, nx double, ny double, nz double")
    out = world.assign_surfels(d.selectExpr("*", "CAST(floor(x / 0.1) AS BIGINT) AS gx", "0L AS gy", "0L AS gz"), 0.1).collect()
    assert copied == [0] and {(r.gx, r.sx) for r in out} == {(0, 0), (5, 5)}
