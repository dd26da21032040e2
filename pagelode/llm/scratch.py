"""Intermediate tables in the cluster's shared folder.

Every iterative or multi-pass operator cuts its lineage by writing a table here and reading it again, so that a
lost executor costs a re-read and not a recomputation, and so that identifiers made while writing stay fixed.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROWS_PER_FILE = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (local runs and tests)."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pagelode-')}"
        spark.conf.set(CHECKPOINT_CONF, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/pagelode-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and return a reader of it.

    most_rows: a known bound of its rows; the table then gets a file for each quarter of a million of them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df if most_rows is None else df.coalesce(most_rows // ROWS_PER_FILE + 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            drop_path(table.sparkSession, path)
    if tables:  # exchanges that nothing refers to go when the driver collects its garbage
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()
