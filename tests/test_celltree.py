"""Nearest neighbours and views through the tree of cells against plain numpy: crowds, far queries, copies, odd rows."""

import math
import re

import numpy as np
import pandas as pd
import pytest

from flightspark.operators import evidence, grid
from flightspark.plans import views

rng = np.random.default_rng(5)
CROWD = np.concatenate([rng.normal(0, 0.01, (900, 3)), rng.random((200, 3)) * 40, [[7.0, 7.0, 7.0]] * 5, [[900.0, -4.0, 0.0]]])


def _points(spark, xyz, name, flights=None):
    d = pd.DataFrame(xyz, columns=["x", "y", "z"])
    d.insert(0, "flight_id", [0] * len(d) if flights is None else flights)
    d[name] = np.arange(len(d))
    return spark.createDataFrame(d)


def _nearest(q, t, limit=math.inf):
    gap = np.sqrt(((q[:, None] - t[None]) ** 2) @ np.ones(3))
    best = gap.argmin(axis=1)
    return {i: (int(np.flatnonzero(gap[i] == gap[i].min())[0]), round(float(gap[i, b]), 9)) for i, b in enumerate(best) if gap[i, b] <= limit}


@pytest.mark.parametrize("limit", [None, 3.0])
def test_nearest_equals_all_pairs(spark, limit):
    q = np.concatenate([rng.normal(0, 0.02, (150, 3)), rng.random((60, 3)) * 60 - 10, [[-5e4, 2.0, 1.0], [7.0, 7.0, 7.5]]])
    got = grid.nearest_neighbor(_points(spark, q, "q_id"), _points(spark, CROWD, "t_id"), "q_id", "t_id", 0.5, max_radius=limit)
    assert {r.q_id: (r.t_id, round(r.distance, 9)) for r in got.collect()} == _nearest(q, CROWD, limit or math.inf)


def test_nearest_odd_rows(spark):
    cols = "flight_id long, {0} long, x double, y double, z double"
    t = spark.createDataFrame([(0, 1, None, 0.0, 0.0), (0, 2, float("nan"), 0.0, 0.0), (0, 3, 9.0, 0.0, 0.0), (1, 4, float("inf"), 0.0, 0.0)], cols.format("t_id"))
    q = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, None, 0.0, 0.0), (0, 3, float("nan"), 1.0, 1.0), (1, 4, 0.0, 0.0, 0.0), (2, 5, 0.0, 0.0, 0.0)], cols.format("q_id"))
    assert [tuple(r) for r in grid.nearest_neighbor(q, t, "q_id", "t_id", 0.5).collect()] == [(0, 1, 3, 9.0)]
    assert grid.nearest_neighbor(q, t.filter("false"), "q_id", "t_id", 0.5).collect() == []


def test_views_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(evidence, "LEAF", 20)
    n = len(CROWD)
    normals = rng.normal(size=(n, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    s = pd.DataFrame(np.hstack([CROWD, normals]), columns=["x", "y", "z", "nx", "ny", "nz"])
    s.insert(0, "flight_id", np.where(np.arange(n) % 10 == 0, 1, 0))
    s["element_id"], s["r"], s["g"], s["b"] = np.arange(n), 1.0, 2.0, 3.0
    views = []
    for k in range(24):
        # Two of three views look at the crowd.
        at = rng.random(3) * 50 - 5
        ahead = rng.normal(size=3) if k % 3 == 0 else -at / np.linalg.norm(at)
        turn, _ = np.linalg.qr(np.column_stack([ahead, rng.normal(size=(3, 2))]))
        turn = turn[:, [1, 2, 0]] * np.sign(turn[:, 0] @ ahead)
        turn[:, 0] *= np.sign(np.linalg.det(turn))
        views.append((k % 2, k, *turn.ravel(), *at, 300.0, 310.0, 160.0, 120.0, 320, 240))
    cols = ["flight_id", "frame_id", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz", "fx", "fy", "cx", "cy", "width", "height"]
    p = pd.DataFrame(views, columns=cols)
    got = evidence.candidate_views(spark.createDataFrame(s), spark.createDataFrame(p)).toPandas()
    want = set()
    for v in views:
        turn, at = np.array(v[2:11]).reshape(3, 3), np.array(v[11:14])
        ray = CROWD - at
        c = ray @ turn
        with np.errstate(all="ignore"):
            u, w = 300.0 * c[:, 0] / c[:, 2] + 160.0, 310.0 * c[:, 1] / c[:, 2] + 120.0
            facing = -(normals * ray).sum(axis=1) / np.linalg.norm(ray, axis=1)
        seen = (c[:, 2] > 0.1) & (u >= 0) & (u < 320) & (w >= 0) & (w < 240) & (facing >= math.cos(math.radians(65.0))) & (s["flight_id"] == v[0])
        want |= {(int(i), v[1]) for i in np.flatnonzero(seen)}
    assert len(want) > 100 and set(zip(got["element_id"], got["frame_id"])) == want and len(got) == len(want)


def test_pairs_are_compiled(spark):
    """A method of 8,000 bytes or more is left to the interpreter by the JVM; the conditions of cells and of pairs once took 19,302 and 8,106."""
    pts = spark.createDataFrame([(0, 1, *[float(k) for k in range(9)])], "flight_id long, element_id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")
    names = [*[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz", "fx", "fy", "cx", "cy"]
    poses = spark.createDataFrame([(0, 1, *[1.0] * 16, 320, 240)], f"flight_id long, frame_id long, {', '.join(n + ' double' for n in names)}, width int, height int")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, val in held.items():
            spark.conf.set(k, val)
        plan = evidence.candidate_views(pts, poses)._jdf.queryExecution()
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen"))
    finally:
        for k, val in before.items():
            spark.conf.set(k, val)
    assert sizes and max(map(int, sizes)) < 8000


def test_pictures_are_made_by_many_tasks(spark, tmp_path):
    keys = [1500 * k for k in range(12)] + [None]
    rows = [(k, 1, 7, 0.01, 20.0, 100.0, 0.02) for k in keys]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_quantity double, l_extendedprice double, l_tax double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    tiles = views.proxy_tiles.anew(spark, str(tmp_path))
    assert tiles.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.flight_id, r.frame_id, r.tile_u, r.tile_v): (r.w, r.h, bytes(r.rgb)) for r in tiles.collect()}
    assert len(got) == 4 * len(keys)
    for (_, frame, tu, tv), (w, h, rgb) in got.items():
        at = [(tu * 16 + i % 16, tv * 16 + i // 16) for i in range(16 * h)] if frame is not None else []
        assert (w, h) == (16, 8 if tv else 16)
        assert rgb == bytes(b for u, v in at for b in ((frame * 7 + u * 13 + v * 5) % 256, (frame * 3 + u * 5 + v * 11) % 256, (u * v + frame) % 256))
