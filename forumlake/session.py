"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

TASK_KEY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows are narrow: shuffled and compressed they take a tenth of the memory their sorts and groups take
    TASK_KEY: "16m",
    # checkpoint files go once no frame refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "forumlake", **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    On a cluster leave `master` unset and pass `spark.checkpoint.dir` (a shared
    folder) and `spark.sql.shuffle.partitions` through the submit command.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def with_small_tasks(spark: SparkSession) -> SparkSession:
    """The session with this library's size of a task, unless it has one of its own."""
    if spark.conf.get(TASK_KEY, None) is None:
        spark.conf.set(TASK_KEY, DEFAULTS[TASK_KEY])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get(CHECKPOINT_KEY, None)
        if path is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
            path = tempfile.mkdtemp(prefix="forumlake-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the plans made and run inside go when each has run, not when the driver next collects garbage.

    Only for results that are written: a frame collected again would have to compute them again.
    """
    before = spark.conf.get(SHUFFLES_KEY, None)
    spark.conf.set(SHUFFLES_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_KEY)
        else:
            spark.conf.set(SHUFFLES_KEY, before)


def freeze(df: DataFrame) -> DataFrame:
    """Materialise reliably, so that later plans see one fixed result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """As `freeze`, but as column files: compressed, and later plans read only the columns they use."""
    path = work_dir(df.sparkSession, name)
    with short_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
