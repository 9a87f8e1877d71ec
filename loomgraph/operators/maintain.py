"""Incremental maintenance: fingerprints, differences, reconciliation, versioned storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import durable, store
from .aggregates import dedup_edges

SCHEMA_VERSION = "7"


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the nodes of ``paths`` (path), the edges that leave them, and their fingerprints; edges into them stay."""
    gone = nodes.join(paths.withColumnRenamed("path", "file"), "file", "left_semi").select(F.col("id").alias("from_id"))
    return nodes.join(paths.withColumnRenamed("path", "file"), "file", "left_anti"), edges.join(gone, "from_id", "left_anti"), files.join(paths, "path", "left_anti")


def reconcile(nodes: DataFrame, edges: DataFrame, paths: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``paths`` replaced by the new ones. Unchanged edges take the new location (so a moved line is not stale)."""
    kept, kept_edges, _ = remove_files(nodes, edges, paths.limit(0), paths)
    return kept.unionByName(new_nodes), dedup_edges(kept_edges.unionByName(new_edges))


def replace_provenance(edges: DataFrame, provenance: str, new: DataFrame) -> DataFrame:
    return dedup_edges(edges.filter(~F.col("provenance").eqNullSafe(provenance)).unionByName(new))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime_ms) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"))


def fingerprints(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime_ms, hash) of the files below a folder. Of files whose size and time are as ``stored`` the hash is taken over;
    only the others are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    now = listing(spark, path)
    hashed = files.select("path", F.sha1("content").alias("hash"))
    if stored is None:
        return now.join(hashed, "path")
    known = now.join(stored.select("path", "size", "mtime_ms", "hash"), ["path", "size", "mtime_ms"])
    rest = now.join(known.select("path"), "path", "left_anti")
    paths = [r[0] for r in rest.select("path").limit(10_001).collect()]
    if len(paths) <= 10_000:  # a file source reads only what it is given
        read = spark.read.format("binaryFile").load(paths).select("path", F.sha1("content").alias("hash")) if paths else hashed.limit(0)
    else:
        read = hashed
    return known.select("path", "size", "mtime_ms", "hash").unionByName(rest.join(read, "path").select("path", "size", "mtime_ms", "hash"))


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed. Equal size and time mean fresh; only else the hash decides."""
    s = stored.select("path", F.struct("size", "mtime_ms", "hash").alias("s"))
    c = current.select("path", F.struct("size", "mtime_ms", "hash").alias("c"))
    fresh = (F.col("s.size") == F.col("c.size")) & ((F.col("s.mtime_ms") == F.col("c.mtime_ms")) | (F.col("s.hash") == F.col("c.hash")))
    change = F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed").when(~fresh, "changed")
    return s.join(c, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def save(graph: Graph, path: str, meta: dict[str, str]) -> int:
    """A new version of the stored graph below ``path``; readers move to it when its marker is there. Gives its number."""
    spark = graph.nodes.sparkSession
    version = (versions(spark, path) or [0])[-1] + 1
    rows = [("schema_version", SCHEMA_VERSION), *meta.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{version}/meta")
    store.write(graph, f"{path}/v{version}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    target, files = durable._file_system(spark, path)
    if not files.exists(target):
        return []
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and store.complete(spark, f"{path}/{n}"))


def load(spark: SparkSession, path: str, root: str | None = None) -> tuple[Graph, dict[str, str]] | None:
    """The newest version and its meta, or None if there is none, or its schema, root or number of nodes is not as stated."""
    found = versions(spark, path)
    if not found:
        return None
    at = f"{path}/v{found[-1]}"
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{at}/meta").collect()}
    if meta.get("schema_version") != SCHEMA_VERSION or (root is not None and meta.get("root") != root):
        return None
    graph = store.read(spark, at)
    if "nodes" in meta and graph.nodes.count() != int(meta["nodes"]):
        return None
    return graph, meta


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored graph with all its versions."""
    durable.delete(spark, path)
