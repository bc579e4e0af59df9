"""Session settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# What one task reads, before and after a shuffle, whatever the input.
TASK_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "800",
}

# An execution's shuffle files are deleted at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_tasks(spark: SparkSession) -> SparkSession:
    """Let the number of tasks grow with the tables instead of the memory of each.

    By default a task takes up to 128 MB of compressed files, or 64 MB of a compressed shuffle in at most
    200 parts, which sorts and hash tables turn into several times as much memory.
    """
    for key, value in TASK_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone and the adaptive settings on a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, one for the
    whole session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stallwise-"))
    return context.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; what is written there goes with the session."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    place, system = _place(spark, path)
    system.delete(place, True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside go at its end, not when the driver next collects its garbage.

    This is a setting of the session, so it is not for several threads at once.
    """
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage and outlives a lost executor; later reads prune columns and push
    filters down, which a row checkpoint does not.
    """
    spark = df.sparkSession
    path = scratch(spark, "staged")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a checkpointed table early; all that was made of it must be written itself."""
    discard(df.sparkSession, df.staged_path)
