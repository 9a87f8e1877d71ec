"""A graph as stored tables: nodes clustered by id, edges by either end, each partitioned by kind.

A look-up by kind reads that kind's files only, and one by id or end those row groups whose range holds it: range partitioning and order
within files keep the ranges narrow at any size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..graph import Graph
from . import durable

#: name -> the column that the table is clustered by
CLUSTERED = {"nodes": "id", "edges": "from_id", "incoming": "to_id"}


def _write(table: DataFrame, by: str, path: str) -> None:
    placed = table.repartitionByRange("kind", by).sortWithinPartitions("kind", by)
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
    table.sparkSession.createDataFrame([(table.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}.schema")


def write(graph: Graph, path: str) -> None:
    """All tables below ``path``; the marker that :func:`complete` looks for comes last."""
    spark = graph.nodes.sparkSession
    for name, by in CLUSTERED.items():
        _write(graph.nodes if name == "nodes" else graph.edges, by, f"{path}/{name}")
    for name in ("sources", "files"):
        if (table := getattr(graph, name)) is not None:
            table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/complete")


def complete(spark: SparkSession, path: str) -> bool:
    return durable.exists(spark, f"{path}/complete/_SUCCESS")


def read(spark: SparkSession, path: str) -> Graph:
    tables = {}
    for name in CLUSTERED:
        schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/{name}.schema").first()[0]))
        tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}").select(schema.names)
    for name in ("sources", "files"):
        if durable.exists(spark, f"{path}/{name}"):
            tables[name] = spark.read.parquet(f"{path}/{name}")
    return Graph(**tables)
