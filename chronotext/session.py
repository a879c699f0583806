"""Session settings and the staging area shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`.

    A local session without that setting gets a temporary folder; a cluster session without it is refused, as a
    machine-local folder would not survive there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="chronotext-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


#: Whether the shuffle files of a query are deleted as soon as it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's own folder, which can be deleted once the application has ended."""
    return f"{shared_dir(spark)}/chronotext/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage (an executor loss re-reads files rather than re-running the plan) and gives the planner the
    true size, so that it broadcasts the table only when that size is below its threshold. The shuffle files of the write
    go with it; the table itself stays until the application's folder is deleted, or `discard` is told.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    swept = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SWEEP, swept) if swept is not None else spark.conf.unset(SWEEP)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what `stage` has written for these tables; nothing may read them, or what was made of them, any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep `df` in executor memory or on their disks while several jobs read it; a lost part is computed again."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out when they come from fewer files than there are task slots; else leave them in place.

    Meant before costly work on each row: a file may be a single split, whatever its size.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if 0 < len(df.inputFiles()) < slots else df
