"""Durable intermediate tables, as the rest of the library writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.durable import checkpoint_dir, clear_materialized, materialize

__all__ = ["checkpoint_dir", "clear_materialized", "materialize", "small_batches"]


def small_batches(df: DataFrame, records: int = 4000) -> None:
    """Whole texts, of up to megabytes, travel to Python workers in Arrow batches: 10,000 of them, Spark's default, are too many beside a
    JVM. Lowers the session's setting to ``records``; a lower one stays. It changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > records:
        df.sparkSession.conf.set(name, str(records))
