"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Where none is set, a temporary one of our own in local mode (tests),
    an error otherwise: executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        path = tempfile.mkdtemp(prefix="strandex-")
        atexit.register(shutil.rmtree, path, True)
        found = f"file://{path}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, so that neither a lost
    executor nor a second use computes it again. The files go when they are dropped() or the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = filesystem(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of written() frames that nothing needs any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            fs, where = filesystem(df.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)


def each(spark: SparkSession, items: list, work: Callable[..., Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """The batches that work yields for each item, an item a task."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from work(items[i])

    return spark.range(0, len(items), 1, max(len(items), 1)).mapInArrow(run, ddl)
