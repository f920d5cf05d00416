"""Streams over several files: order of event time, late rows, forgotten keys, and the surfel table by tiles."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flightspark.streaming import streams as st

HOUR = 3_600


def _feed(spark, folder, schema, parts):
    """A stream over the first part and what brings the others; seconds in column `s` become ts."""

    def bring(rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).coalesce(1).write.mode("append").parquet(str(folder))

    bring(parts[0])
    full = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(full).parquet(str(folder)), [lambda p=p: bring(p) for p in parts[1:]]


def _machine(rows):
    """The life cycle in plain Python over rows that are in order."""
    now, out = "created", []
    for _, seq, want in rows:
        base = "reconstructing" if now in st.RUNNING else now
        ok = want in st.NEXT[base]
        now = want if ok else now
        out.append((seq, want, now, ok))
    return out


def test_commands_of_several_files_are_applied_in_event_time(spark, tmp_path):
    rnd = random.Random(5)
    names = ["uploaded", "reconstructing", "ready", "georeferencing", "failed"]
    rows = [(m, 600 * i, 100 * m + i, rnd.choice(names)) for m in (1, 2, 3) for i in range(40)]
    # A row comes up to 50 minutes after rows that are later than itself.
    arrival = sorted(rows, key=lambda r: r[1] + rnd.randrange(0, 3000))
    end = (9, 40 * 600 + 2 * HOUR, 999, "uploaded")
    parts = [arrival[:40], arrival[40:80], arrival[80:], [end]]
    stream, later = _feed(spark, tmp_path / "in", "mission_id long, s long, seq long, status string", parts)
    got = st.run_to_table(st.mission_state_machine(stream), "append", later).collect()
    for m in (1, 2, 3):
        mine = sorted((r.seq, r.requested, r.status, r.accepted) for r in got if r.mission_id == m)
        assert mine == _machine([r[1:] for r in rows if r[0] == m])
    assert not [r for r in got if r.mission_id == 9]  # within the last hour, so held back


def test_rows_behind_the_watermark_are_dropped_and_ended_missions_forgotten(spark, tmp_path):
    week = st.IDLE_MS // 1000
    parts = [[(1, 0, 1, "uploaded"), (1, 60, 2, "cancelled"), (2, 30, 3, "uploaded"), (3, 5 * HOUR, 4, "uploaded")],
             [(1, 100, 5, "uploaded"), (1, 6 * HOUR, 6, "uploaded")],                                       # 5 is four hours late
             [(3, 2 * week, 7, "uploaded")],
             [(1, 2 * week + 60, 8, "uploaded"), (2, 2 * week + 60, 9, "reconstructing"), (3, 2 * week + 2 * HOUR, 10, "uploaded")]]
    stream, later = _feed(spark, tmp_path / "in", "mission_id long, s long, seq long, status string", parts)
    got = {r.seq: (r.status, r.accepted) for r in st.run_to_table(st.mission_state_machine(stream), "append", later).collect()}
    assert 5 not in got and got[6] == ("cancelled", False)
    assert got[8] == ("uploaded", True)           # cancelled long ago and forgotten
    assert got[9] == ("reconstructing", True)     # 2 had not ended, so it is still known as uploaded


def test_stage_times_do_not_depend_on_arrival(spark, tmp_path):
    rows = [(1, 0, 1, "stage_start", "a"), (1, 600, 2, "stage_start", "b"), (1, 1500, 3, "stage_end", "b"), (1, 1600, 4, "stage_end", "b"),
            (1, 1700, 5, "stage_start", None), (1, 1900, 6, "stage_end", None), (1, 9000, 7, "stage_start", "z")]
    parts = [[rows[0], rows[2]], [rows[1], rows[5]], [rows[4], rows[3]], [rows[6]]]
    stream, later = _feed(spark, tmp_path / "in", "job_id long, s long, seq long, kind string, stage string", parts)
    got = sorted(r[1:4] for r in st.run_to_table(st.stage_duration_stream(stream), "append", later).collect())
    assert got == [("a", 600.0, 2), ("b", 900.0, 3)]  # a stage without a name is none


def _points(spark, n, frames, seed):
    rnd = random.Random(seed)
    rows = [(1 + k % 2, rnd.choice(frames), *(rnd.random() * 2 - 1 for _ in range(3)), 0.0, 0.0, 1.0, 10.0, 20.0, 30.0, rnd.random()) for k in range(n)]
    return spark.createDataFrame(rows, "flight_id long, frame_id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double, conf double")


def test_a_batch_rewrites_only_its_tiles_and_can_be_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "TILE", 4)
    folder, cell = str(tmp_path / "world"), 0.25
    corner = "x > 0.3 AND y > 0.3 AND z > 0.3 AND flight_id = 1"
    batches = [_points(spark, 150, range(10), 1), *[_points(spark, 150, range(10 * k, 10 * k + 10), k).filter(corner) for k in (2, 3)]]

    def files():
        return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}

    def rows(df):
        return sorted((r.flight_id, r.sx, r.sy, r.sz, r.sbin, r.sround, r.observation_count, round(r.x, 9), round(r.score, 9)) for r in df.collect())

    st.merge_points(batches[0], 0, folder, cell)
    first = files()
    st.merge_points(batches[1], 1, folder, cell)
    second = files()
    written = [p for p in second if "batch=1" in p]
    assert all(second[p] == t for p, t in first.items()) and written and len(written) < len(first) / 2 and not [p for p in written if "flight_id=2" in p]
    st.merge_points(batches[2], 2, folder, cell)
    once = rows(st.read_world(spark, folder))
    st.merge_points(batches[2], 2, folder, cell)
    assert rows(st.read_world(spark, folder)) == once
    # No tile keeps more than its newest batch and the one before it.
    kept = {}
    for p in files():
        kept.setdefault(p.split("/batch=")[0], set()).add(p.split("/batch=")[1].split("/")[0])
    assert max(len(k) for k in kept.values()) == 2 and sum(len(k) for k in kept.values()) < len(second) + len(written)

    # The same batches in a table of very large tiles.
    monkeypatch.setattr(st, "TILE", 1 << 20)
    for k, b in enumerate(batches):
        st.merge_points(b, k, str(tmp_path / "wide"), cell)
    assert rows(st.read_world(spark, str(tmp_path / "wide"))) == once


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "world")
    some = _points(spark, 40, range(5), 1)
    st.merge_points(some.filter("false"), 0, folder)
    assert st.read_world(spark, folder) is None
    st.merge_points(some, 1, folder)
    n = st.read_world(spark, folder).count()
    st.merge_points(some.filter("false"), 2, folder)
    assert n and st.read_world(spark, folder).count() == n
