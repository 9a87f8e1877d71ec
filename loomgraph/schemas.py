"""The closed schema of the code graph: node kinds, edge kinds, and the tables' columns."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: the vocabulary of the graph
NODE_KINDS = ("File", "Module", "Class", "Interface", "Enum", "Function", "Method", "Property", "Variable", "TypeAlias", "Route", "Component")
EDGE_KINDS = ("Defines", "Imports", "ImportsType", "Calls", "References", "UsesType", "Returns", "Instantiates", "Implements", "Inherits", "Overrides")
PROVENANCES = ("resolved", "heuristic", "dispatch", "call-ref", "call", "type", "prisma-ref", "prisma", "route-test", "env-ref", "env")
STRATEGIES = ("exact-type", "arity-fallback", "implicit-constructor", "heuristic")
TIERS = ("deep", "baseline")

RANGE = T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
SITE = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])

NODES = T.StructType(
    [
        T.StructField("project", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("file", T.StringType()), T.StructField("qualified_name", T.StringType()), T.StructField("range", RANGE), T.StructField("tier", T.StringType()), T.StructField("external", T.BooleanType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("project", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("from_id", T.StringType()), T.StructField("to_id", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("provenance", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("strategy", T.StringType()), T.StructField("at", SITE), T.StructField("sites", T.ArrayType(SITE)),
    ]
)
FILES = T.StructType([T.StructField("project", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime_ms", T.DoubleType()), T.StructField("hash", T.StringType()), T.StructField("language", T.StringType()), T.StructField("tier", T.StringType())])
SOURCES = T.StructType([T.StructField("project", T.StringType()), T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))])
META = T.StructType([T.StructField("project", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
