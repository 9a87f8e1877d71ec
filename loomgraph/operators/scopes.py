"""Joins of names to files by folders: the nearest ancestor, the nearest configuration file, and the longest prefix.

Each explodes a path or a name into its few ancestors or prefixes and joins these by equality, so that none is an inequality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname


def ancestors(path: Column) -> Column:
    """The folders of a path, its own first, the root (empty) last."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _each_ancestor(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` once for each folder above ``path`` (folder, distance)."""
    return rows.select("*", F.posexplode(ancestors(dirname(F.col(path)))).alias("distance", "folder"))


def nearest_ancestor(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name, target): for a file's import of ``name`` (a path below some source root), the file of that path below the nearest
    folder above the importing file. ``wanted`` is (file, name), ``files`` is (path)."""
    asked = _each_ancestor(wanted.select("file", "name").distinct(), "file")
    place = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    found = asked.withColumn("path", place).join(files.select("path").distinct(), "path").filter(F.col("path") != F.col("file"))
    return found.groupBy("file", "name").agg(F.min_by("path", "distance").alias("target"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(file, config): the configuration file in the nearest folder at or above each file. ``files`` is (file), ``configs`` is (path)."""
    at = configs.groupBy(dirname(F.col("path")).alias("folder")).agg(F.min("path").alias("config"))  # one row a folder, however often it is listed
    return _each_ancestor(files.select("file").distinct(), "file").join(at, "folder").groupBy("file").agg(F.min_by("config", "distance").alias("config"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, separator: str = "\\") -> DataFrame:
    """(name, prefix, folder, rest): the longest prefix (prefix, folder) of whole segments that begins each name, and what follows it."""
    parts = F.split("name", "\\\\" if separator == "\\" else f"[{separator}]")
    cut = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    each = names.select("name").distinct().select("name", F.posexplode(cut).alias("dropped", "prefix"))
    found = each.join(prefixes, "prefix").groupBy("name").agg(F.min_by(F.struct("prefix", "folder"), "dropped").alias("p"))
    rest = F.expr("substring(name, length(p.prefix) + 2)")
    return found.select("name", "p.prefix", "p.folder", rest.alias("rest"))
