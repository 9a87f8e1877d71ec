"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def reserve(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted as materialised tables are."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage, survives the loss of any executor, and is compressed (unlike an RDD checkpoint).
    """
    spark = df.sparkSession
    path = reserve(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


@contextlib.contextmanager
def scope():
    """Deletes what :func:`materialize` writes inside, at its end; a result must have been consumed or written elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        clear_materialized(before)


def clear_materialized(keep: int = 0) -> None:
    """Delete every table that :func:`materialize` wrote, but for the first ``keep``; also runs at exit."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # the JVM may have ended before us; the folder is the cluster's own scratch space
            return


atexit.register(clear_materialized)
