"""Structured Streaming operators: mission status and life cycle, stage times, telemetry, world fusion.

Rows of a key are applied in the order of event time, whatever file or trigger they come with: they are held back until the
watermark has passed them (`in_order`). Rows that arrive more than `LATE` behind the newest are dropped by the watermark. What a task holds
of one key is its state of a few numbers and its rows of the last hour of event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flightspark.functions.geodesy import E2, WGS84_A
from flightspark.operators.grid import cell_aggregate, neighbours
from flightspark.operators.scale import attach
from flightspark.operators.world import STATE_FIELDS, SURFEL_KEY, assign_surfels, fold_observations
from flightspark.session import checkpointed, shared_folder

LATE = "1 hour"
# Milliseconds of event time after which a silent flight, job or ended mission is forgotten, a job with a stage that it never ended.
IDLE_MS = 7 * 24 * 3_600_000
# Mission life cycle; a later status is reached only from the ones listed.
RUNNING = ["extracting_gps", "extracting_frames", "estimating_poses", "reconstructing_geometry", "creating_model", "georeferencing"]
FINAL = ["ready", "failed", "cancelled"]
NEXT = {"created": ["uploaded", "cancelled", "failed"], "uploaded": ["reconstructing", "uploaded", "cancelled", "failed"],
        "reconstructing": [*RUNNING, "ready", "cancelled", "failed"], "failed": ["reconstructing", "uploaded"], "ready": ["reconstructing"], "cancelled": []}


def mission_status_stream(updates: DataFrame) -> DataFrame:
    """Latest status of every mission (mission_id, ts, seq, status, progress); use update mode."""
    latest = F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq"))
    return updates.groupBy("mission_id").agg(latest.alias("_l")).select("mission_id", "_l.*")


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them to `step` in order, with what it kept of earlier rows.

    One timer a key: at the earliest row held, or, where none is, at the time at which the key is forgotten.
    """

    def __init__(self, step: Callable, rows: str, kept: str, idle: Callable):
        self.step, self.rows, self.kept, self.idle = step, rows, kept, idle
        self.names = [c.split()[0] for c in rows.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.rows)
        self.state = handle.getValueState("kept", self.kept)
        self.due = handle.getValueState("due", "due long, last long")

    def _plan(self, due: int | None, last: int) -> None:
        old = self.due.get()[0] if self.due.exists() else None
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if due is None:
            self.due.clear()
            return
        if old != due:
            self.handle.registerTimer(due)
        self.due.update((due, last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, last = False, -1
        if self.due.exists():
            due, last = self.due.get()
            waiting = self.held.exists()
        first = None
        for pdf in rows:
            self.held.appendList(list(pdf[self.names].astype(object).where(pdf[self.names].notna(), None).itertuples(index=False, name=None)))
            low = int(pdf["us"].min()) // 1000 + 1
            first = low if first is None else min(first, low)
        self._plan(min(first, due) if waiting else first, last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        last = self.due.get()[1]
        self.due.clear()  # the timer that fired is gone
        rows = sorted(self.held.get(), key=lambda r: r[:2]) if self.held.exists() else []
        ready = [r for r in rows if r[0] // 1000 < mark]
        rest = rows[len(ready):]
        state = self.state.get() if self.state.exists() else None
        if ready:
            last = ready[-1][0] // 1000
            out, state = self.step(key, pd.DataFrame(ready, columns=self.names), state)
            self.state.update(state)
            if len(out):
                yield out
        if rest:
            if ready:
                self.held.put(rest)
            self._plan(rest[0][0] // 1000 + 1, last)
            return
        self.held.clear()
        wait = None if state is None else self.idle(state)
        if wait is not None and last + wait < mark:
            self.state.clear()
        elif wait is not None:
            self._plan(last + wait + 1, last)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, step: Callable, held: str, kept: str, out: str, idle: Callable) -> DataFrame:
    """Applies `step(key, rows, kept) -> (out, kept)` to the rows of every key in the order of (us, second column of `held`).

    `rows` carries the watermark column ts. `idle` gives the milliseconds after which a key in this state is forgotten, or None.
    The query needs the RocksDB state store (`run_to_table` sets it).
    """
    names = [c.split()[0] for c in held.split(", ")]
    d = rows.withWatermark("ts", LATE).withColumn("us", F.unix_micros("ts")).select(key, "ts", *names)
    return d.groupBy(key).transformWithStateInPandas(_InOrder(step, held, kept, idle), out, "append", "eventtime")


def _advance(key, rows: pd.DataFrame, state) -> tuple[pd.DataFrame, tuple]:
    now = "created" if state is None else state[0]
    out = []
    for seq, want in zip(rows["seq"], rows["status"]):
        ok = want in NEXT["reconstructing" if now in RUNNING else now]
        if ok:
            now = want
        out.append((key[0], seq, want, now, ok))
    return pd.DataFrame(out, columns=["mission_id", "seq", "requested", "status", "accepted"]), (now,)


def mission_state_machine(commands: DataFrame) -> DataFrame:
    """Every requested status change with the status after it and whether it was allowed (mission_id, ts, seq, status).

    A cancelled mission stays cancelled; a start is ignored while the mission runs. A mission that is ready, failed or cancelled and
    silent for a week of event time is forgotten; commands that come after that are those of a new mission.
    """
    return in_order(commands, "mission_id", _advance, "us long, seq long, status string", "status string",
                    "mission_id long, seq long, requested string, status string, accepted boolean", lambda s: IDLE_MS if s[0] in FINAL else None)


def _pair_stages(key, rows: pd.DataFrame, state) -> tuple[pd.DataFrame, tuple]:
    stage, since = (None, None) if state is None else state
    out = []
    for us, seq, kind, name in rows.itertuples(index=False, name=None):
        t = us / 1e6
        if kind == "stage_start":
            if stage is not None:
                out.append((key[0], stage, t - since, seq))
            stage, since = name, t
        else:
            if stage is not None and stage == name:
                out.append((key[0], stage, t - since, seq))
            stage, since = None, None
    return pd.DataFrame(out, columns=["job_id", "stage", "seconds", "seq"]), (stage, since)


def stage_duration_stream(events: DataFrame) -> DataFrame:
    """Finished stages with their seconds (job_id, ts, seq, kind, stage); a start ends the stage that is open.

    A job that is silent for a week of event time is forgotten.
    """
    e = events.filter(F.col("kind").isin("stage_start", "stage_end"))
    return in_order(e, "job_id", _pair_stages, "us long, seq long, kind string, stage string", "stage string, since double",
                    "job_id long, stage string, seconds double, seq long", lambda s: IDLE_MS)


def _to_ecef(lat, lon, alt):
    phi, lam = np.radians(lat), np.radians(lon)
    n = WGS84_A / np.sqrt(1.0 - E2 * np.sin(phi) ** 2)
    return np.stack([(n + alt) * np.cos(phi) * np.cos(lam), (n + alt) * np.cos(phi) * np.sin(lam), (n * (1.0 - E2) + alt) * np.sin(phi)], axis=-1)


def _local_track(key, pdf: pd.DataFrame, state) -> tuple[pd.DataFrame, tuple]:
    if state is not None:
        lat0, lon0, alt0, *last = state
    else:
        lat0, lon0, alt0 = (float(pdf[c].iloc[0]) for c in ("lat", "lon", "alt"))
        last = [None] * 4
    d = _to_ecef(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["alt"].to_numpy()) - _to_ecef(lat0, lon0, alt0)
    p, q = np.radians(lat0), np.radians(lon0)
    rot = np.array([[-np.sin(q), np.cos(q), 0.0], [-np.sin(p) * np.cos(q), -np.sin(p) * np.sin(q), np.cos(p)], [np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)]])
    enu, t = d @ rot.T, pdf["t"].to_numpy(dtype=float)
    # A record whose clock is not ahead of those before it has no velocity and is no predecessor.
    newest = np.maximum.accumulate(np.concatenate([[-np.inf if last[0] is None else last[0]], t]))[:-1]
    on_time = t > newest
    path = np.column_stack([t, enu])[on_time]
    vel = np.full(enu.shape, np.nan)
    if len(path):
        before = np.vstack([path[:1] if last[0] is None else [last], path[:-1]])
        vel[on_time] = (path[:, 1:] - before[:, 1:]) / np.maximum(1e-4, path[:, :1] - before[:, :1])
        last = path[-1].tolist()
    out = pd.DataFrame({"flight_id": key[0], "rec_no": pdf["rec_no"].to_numpy(), "enu_x": enu[:, 0], "enu_y": enu[:, 1], "enu_z": enu[:, 2],
                        "vx": vel[:, 0], "vy": vel[:, 1], "vz": vel[:, 2]})
    return out, (lat0, lon0, alt0, *[None if c is None else float(c) for c in last])


def telemetry_stream(records: DataFrame) -> DataFrame:
    """Local position and velocity of records in the order of event time (flight_id, rec_no, ts timestamp, t seconds, lat, lon, alt).

    The first record is the origin. A record whose `t` is not ahead of those before it keeps its position and has no velocity. A flight that is
    silent for a week of event time is forgotten.
    """
    return in_order(records, "flight_id", _local_track, "us long, rec_no long, t double, lat double, lon double, alt double",
                    "lat0 double, lon0 double, alt0 double, t double, x double, y double, z double",
                    "flight_id long, rec_no long, enu_x double, enu_y double, enu_z double, vx double, vy double, vz double", lambda s: IDLE_MS)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode: str, arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Runs a stream over what is there now and returns its output with the batch number; a repeated batch replaces itself.

    After that each of `arrivals` brings new files, and the query starts again where it stopped."""
    spark = stream.sparkSession
    base = shared_folder(spark, "streams")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        for arrive in (lambda: None, *arrivals):
            arrive()
            q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")


# ---- the surfel table that arriving points are fused into --------------------------------------------------------------------

#: Cells along a side of a tile, the unit in which the surfel table is rewritten.
TILE = 512
_SEED = ["s_" + c for c in ("x", "y", "z", "nx", "ny", "nz")]
_TILES = ["flight_id", "tile"]


def _tile(x: str, y: str, z: str):
    return F.concat_ws("_", *[F.floor(F.col(c) / TILE) for c in (x, y, z)])


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of the table's folder, flight_id=/tile=/batch= below it; None before the first write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", folder).schema(_surfel_schema()).parquet(folder)


def _surfel_schema() -> T.StructType:
    kinds = {"observation_count": "long", "n_frames": "long", "last_frame": "long", "level": "string", "provenance": "string"}
    cols = [*[(c, "long") for c in ("sx", "sy", "sz")], ("sbin", "int"), ("sround", "int"), *[(c, kinds.get(c, "double")) for c in STATE_FIELDS],
            *[(c, "double") for c in _SEED], ("flight_id", "long"), ("tile", "string"), ("batch", "int")]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in cols])


def read_world(spark: SparkSession, folder: str, before: int | None = None, tiles: DataFrame | None = None) -> DataFrame | None:
    """The surfel table: of each tile the rows that its newest batch wrote, or its newest before batch `before`; of `tiles` only."""
    rows = _stored(spark, folder)
    if rows is None:
        return None
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if tiles is not None:
        rows = rows.join(tiles, _TILES, "left_semi")
    newest = rows.groupBy(*_TILES).agg(F.max("batch").alias("batch"))
    return attach(rows, newest, [*_TILES, "batch"], "left_semi")


def merge_points(batch: DataFrame, batch_id: int, folder: str, cell: float = 0.08, poses: DataFrame | None = None) -> None:
    """Fuses the points of one batch into the table at `folder`; frames must arrive in order.

    Only the tiles that gain observations are written again, as partitions (flight_id, tile, batch); all others keep their files. A repeated batch
    starts from what was there before it and overwrites its own partitions. What a tile held two batches of its own ago is deleted.
    """
    spark = batch.sparkSession
    obs = checkpointed(cell_aggregate(batch, cell, poses))
    around = neighbours(obs.select("flight_id", F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.col("gz").alias("cz")).distinct())
    near = checkpointed(around.select("flight_id", _tile("cx", "cy", "cz").alias("tile")).distinct())
    prior = read_world(spark, folder, batch_id, near)
    seeds = None
    if prior is not None:
        prior = checkpointed(prior)
        seeds = prior.select(*SURFEL_KEY, *_SEED)
    assigned = assign_surfels(obs, cell, seeds=seeds)
    if assigned is None:
        return
    fresh = assigned.groupBy(*SURFEL_KEY).agg(F.min_by(F.struct(*[F.col(c[2:]).alias(c) for c in _SEED]), "frame_id").alias("_s")).select(*SURFEL_KEY, "_s.*")
    if prior is not None:
        touched = checkpointed(assigned.select("flight_id", _tile("sx", "sy", "sz").alias("tile")).distinct())
        prior = prior.join(touched, _TILES, "left_semi")
        seeds = prior.select(*SURFEL_KEY, *_SEED)
        fresh = seeds.unionByName(fresh.join(seeds.select(*SURFEL_KEY), SURFEL_KEY, "left_anti"))
    state = fold_observations(assigned, SURFEL_KEY, prior)
    out = state.join(fresh, SURFEL_KEY).withColumns({"tile": _tile("sx", "sy", "sz"), "batch": F.lit(batch_id)})
    out = out.select([F.col(f.name).cast(f.dataType) for f in _surfel_schema().fields])
    out.repartition(*_TILES).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_TILES, "batch").parquet(folder)
    _forget(spark, folder, near, batch_id)


def _forget(spark: SparkSession, folder: str, tiles: DataFrame, batch_id: int) -> None:
    """Deletes what a tile held before the last batch but one that wrote it; a repeated batch still finds where it began."""
    kept = _stored(spark, folder).filter(F.col("batch") < batch_id).join(tiles, _TILES, "left_semi").select(*_TILES, "batch").distinct()
    old = checkpointed(kept).withColumn("newest", F.expr("max(batch) OVER (PARTITION BY flight_id, tile)")).filter("batch < newest")
    for r in old.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/flight_id={r.flight_id}/tile={r.tile}/batch={r.batch}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fuse_stream(points: DataFrame, folder: str, checkpoint: str, poses: DataFrame | None = None, cell: float = 0.08):
    """Starts fusing a stream of points into the surfel table at `folder`; returns the running query."""
    return points.writeStream.foreachBatch(lambda b, i: merge_points(b, i, folder, cell, poses)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
