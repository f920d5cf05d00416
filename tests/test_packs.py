"""Passes over packed frames: what they leave on disk, and that they give the rows of a join."""

import math
import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from flightspark.operators import depth as dp
from flightspark.session import checkpointed

POSE = ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int"
DOWN = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)


def shuffle_files(spark) -> dict[str, int]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p): p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


def shuffled_bytes(spark, df) -> int:
    before = shuffle_files(spark)
    df.write.format("noop").mode("overwrite").save()
    return sum(n for p, n in shuffle_files(spark).items() if p not in before)


def eyes(spark, frames: int, flight: int = 1):
    rows = [(flight, f, *DOWN, 0.3 * f, 0.1 * (f % 3), 8.0, 7.5, 7.5, 8.0, 6.0, 16, 12) for f in range(frames)]
    return spark.createDataFrame(rows, "flight_id long, frame_id long, " + POSE)


def pixels(frames: int):
    return [(1, f, u, v, 8.0 + 0.15 * ((u * 3 + v + f) % 5 - 2), float((u + v) % 7) / 7) for f in range(frames) for v in range(12) for u in range(16)]


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = set(shuffle_files(spark))
    t = checkpointed(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert t.count() == 7
    # The count of the table itself may leave its own; those of the write hold twenty thousand rows.
    assert sum(n for p, n in shuffle_files(spark).items() if p not in before) < 2_000


def test_views_agree_as_if_each_pixel_had_met_each_other(spark):
    rows = pixels(4)
    rows += [rows[5], rows[200]]  # the same pixel twice, in two frames
    odd = [(1, None, 2, 2, 8.0, 0.5), (1, 2, None, 3, 8.0, 0.5), (1, 3, 40, 3, None, 0.5)]
    px = spark.createDataFrame(rows + odd, "flight_id long, frame_id long, u long, v long, depth double, conf double").repartition(7)
    poses = eyes(spark, 4)
    pairs = [(1, a, b) for a in range(4) for b in range(4) if a != b and (a + b) % 3]
    got = Counter((r["frame_id"], r["u"], r["v"], r["seen"], r["agree"], round(r["depth_sum"], 9), r["conf"]) for r in
                  dp.cross_view_agree(px, poses, spark.createDataFrame(pairs, "flight_id long, frame_id long, checker long")).collect())
    eye = {r["frame_id"]: r for r in poses.collect()}
    found = {}
    for _, f, u, v, z, _ in rows:
        p = eye[f]
        x, y = (u - 8) * z / 7.5 + p["tx"], -(v - 6) * z / 7.5 + p["ty"]
        for _, a, b in pairs:
            q = eye[b]
            zj = 8.0 - (8.0 - z)
            mx, my = 7.5 * (x - q["tx"]) / zj + 8, 7.5 * -(y - q["ty"]) / zj + 6
            if a == f and 0 <= mx <= 15 and 0 <= my <= 11:
                for _, g, cu, cv, dj, _ in rows:
                    if g == b and (cu, cv) == (round(mx), round(my)):
                        s = found.setdefault((f, u, v), [0, 0, 0.0])
                        hit = abs(dj - zj) < max(0.05, zj * 0.02)
                        found[f, u, v] = [s[0] + 1, s[1] + hit, s[2] + dj * hit]
    want = Counter((f, u, v, *(lambda s: (s[0], s[1], round(s[2], 9)))(found.get((f, u, v), [0, 0, 0.0])), c) for _, f, u, v, _, c in rows + odd)
    assert got == want and any(k[3] for k in got)


def test_pixels_are_sent_packed(spark):
    px = checkpointed(spark.createDataFrame(pixels(60), "flight_id long, frame_id long, u long, v long, depth double, conf double").coalesce(2))
    pairs = spark.createDataFrame([(1, f, (f + k) % 60) for f in range(60) for k in (1, 2, 3)], "flight_id long, frame_id long, checker long")
    # Row by row, a pixel and its samples took about a hundred bytes of the shuffles.
    assert shuffled_bytes(spark, dp.cross_view_agree(px, eyes(spark, 60), pairs)) < 60 * 192 * 60


def test_a_ray_counts_a_voxel_once_and_visits_are_summed_before_they_are_sent(spark):
    one = [(1, 0, 8, 6, 7.93, 0.5, 10.0, 20.0, 30.0)]
    schema = "flight_id long, frame_id long, u long, v long, depth double, conf double, r double, g double, b double"
    got = {(r["gx"], r["gy"], r["gz"]): r for r in dp.tsdf_integrate(spark.createDataFrame(one * 2, schema), eyes(spark, 1), 0.4).collect()}
    z = 8.0 - 7.93
    want = {(0, 0, k): (k + 0.5) * 0.4 - z for k in range(-6, 7) if abs((k + 0.5) * 0.4 - z) <= 1.6}
    inner = {k: w for k, w in want.items() if abs(w) < 1.4}
    assert set(inner) <= set(got) <= set(want)
    assert all(math.isclose(abs(got[k]["sdf"]), abs(w), abs_tol=1e-9) and math.isclose(got[k]["weight"], 0.5) and math.isclose(got[k]["g"], 20.0) for k, w in inner.items())
    random.seed(1)
    px = [(1, f, u, v, 7.5 + random.random(), 0.5, 1.0, 2.0, 3.0) for f in range(100) for v in range(12) for u in range(16)]
    many = checkpointed(spark.createDataFrame(px, schema).coalesce(2))
    # Visits were sent one by one before, about 256 bytes a pixel.
    assert shuffled_bytes(spark, dp.tsdf_integrate(many, eyes(spark, 100).withColumn("tx", F.col("tx") / 100), 0.4)) < len(px) * 60


def seen_world(spark, frames: int = 40):
    """Surfels on a plane that all of the views look down on, the views, and their pictures of one grey level a frame."""
    grid = [(1, i * 40 + j, 0.1 * i, 0.1 * j, 0.001 * ((i * 7 + j) % 9), 0.0, 0.0, 1.0, 90.0, 90.0, 90.0) for i in range(40) for j in range(40)]
    s = spark.createDataFrame(grid, "flight_id long, element_id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")
    poses = eyes(spark, frames).withColumns({"tx": F.col("tx") / frames + 1.5, "ty": F.col("ty") + 1.5, "tz": F.lit(4.0)})
    tiles = spark.createDataFrame([(1, f, t, 0, 8, 12, bytes([80 + f] * 8 * 12 * 3)) for f in range(frames) for t in range(2)], "flight_id long, frame_id long, tile_u int, tile_v int, w int, h int, rgb binary")
    return checkpointed(s), checkpointed(poses), tiles


def test_pairs_of_surfels_and_views_are_not_sent(spark):
    from flightspark.operators import evidence as ev
    from flightspark.operators import texture as tx

    s, poses, tiles = seen_world(spark)
    pairs = ev.candidate_views(s, poses)
    n = pairs.count()
    assert n > 30_000
    # A surfel goes to a block of views once; each of its pairs once took about forty bytes to find what hides it, and more to its pixel.
    assert shuffled_bytes(spark, tx.visible_samples(pairs)) < 8 * n
    support = s.select("flight_id", "element_id", F.lit(3).cast("long").alias("frame_id"))
    assert shuffled_bytes(spark, ev.validate_views(pairs, support, tiles, 12)) < 24 * n


def test_tests_of_views_are_those_of_their_pixels(spark):
    from flightspark.operators import evidence as ev
    from flightspark.operators import texture as tx

    tiles = spark.createDataFrame([(1, f, 0, 0, 12, 10, bytes([50 * f] * 12 * 10 * 3)) for f in (1, 2)], "flight_id long, frame_id long, tile_u int, tile_v int, w int, h int, rgb binary")
    cols = "flight_id long, frame_id long, element_id long, u double, v double, r double, g double, b double, width int, height int, weight double"
    rows = [(1, 1, 7, 5.5, 4.5, 60.0, 60.0, 60.0, 12, 10, 1.0), (1, 1, 8, 5.0, 4.0, 200.0, 200.0, 200.0, 12, 10, 1.0), (1, 2, 7, 1.0, 4.0, 60.0, 60.0, 60.0, 12, 10, 1.0),
            (1, 2, 9, 6.0, 6.0, None, 60.0, 60.0, 12, 10, 1.0), (1, 3, 7, 6.0, 6.0, 60.0, 60.0, 60.0, 12, 10, 1.0), (1, None, 7, 6.0, 6.0, 60.0, 60.0, 60.0, 12, 10, 1.0), (1, 2, 5, 6.0, 6.0, 60.0, 60.0, 60.0, 12, 10, 1.0)]
    c = spark.createDataFrame(rows, cols)
    support = spark.createDataFrame([(1, 5, 2), (1, 7, None)], "flight_id long, element_id long, frame_id long")
    got = sorted((tuple(r) for r in ev.validate_views(c, support, tiles, 12).select("frame_id", "element_id", "supporting", "tested", "agrees", "error").collect()), key=str)
    want = [(1, 7, False, True, True, 10 / 15.0), (1, 8, False, True, False, 5.25), (2, 7, False, False, False, None), (2, 9, False, True, None, 5.25),
            (3, 7, False, False, False, None), (None, 7, False, False, False, None), (2, 5, True, False, True, None)]
    assert got == sorted(want, key=str)
    lit = {(r["frame_id"], r["element_id"]): (r["sr"], r["weight"]) for r in tx.bilinear_sample(c, tiles, 12).collect()}
    assert lit == {(1, 7): (50.0, 1.0), (1, 8): (50.0, 1.0), (2, 7): (100.0, 1.0), (2, 9): (100.0, 1.0), (2, 5): (100.0, 1.0)}


def test_all_targets_of_a_flight_are_refined(spark, tmp_path):
    """More than the sixty a flight that were left of them, from line items that make one confident roof or building each."""
    from flightspark.plans import views, world

    rows = [(k, 1 + k % 4, (k * 7) % 20, 0.0, 1.0 + 13 * (k % 4), 20.0 + k, 0.01) for k in range(1400)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_quantity double, l_extendedprice double, l_tax double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    s = views.surfels(spark, str(tmp_path)).filter("confidence_level = 'HIGH' AND semantic_class IN ('facade', 'roof', 'building')")
    want = {(r.flight_id, r.element_id) for r in s.collect()}
    got = world._hr_refine(spark, str(tmp_path)).collect()
    assert len(want) > 61 and {(r.flight_id, r.element_id) for r in got} == want and len(got) == len(want)
    assert 0 < sum(r.refined for r in got)


def test_poses_and_points_of_tracks_are_not_sent_to_all_tasks(spark):
    from flightspark.operators import tracks as tr

    poses = checkpointed(eyes(spark, 20))
    obs = checkpointed(spark.createDataFrame([(1, t, f, 8.0 + t, 6.0) for t in range(5) for f in range(20)], "flight_id long, track_id long, frame_id long, u double, v double"))
    posed = tr._posed(tr.filter_tracks(obs, 2, poses), poses)
    errors = tr._errors(checkpointed(posed), checkpointed(obs.select("flight_id", "track_id").distinct().selectExpr("*", "1D AS x", "1D AS y", "0D AS z")))
    for d in (posed, errors):
        d.write.format("noop").mode("overwrite").save()
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert posed.count() == 100 and errors.count() == 100
