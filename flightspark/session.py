"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flightspark", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings win when it sets them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, or a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="flightspark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name for a folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Spark then drops the shuffle files of a finished statement at once, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Statements that run inside leave no shuffle files. A write has a plan of its own, so no later one can look for them."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` as a table in the shared checkpoint folder, so that it is computed once and survives lost executors.

    A written table also starts a fresh plan: statistics are the true sizes, columns are pruned on reading, and loops do not
    carry the constraints of earlier rounds along. What was shuffled for it is dropped once it is written.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "tables")
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
