"""Whole-graph derivations: each a pure function (nodes, edges) -> edges of one provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dirname, segments, simple_name
from ..plans.durable import materialize
from .aggregates import dedup_edges

COLUMNS = ["seq", "from_id", "to_id", "kind", "provenance", "confidence", "line"]


def _edges(rows: DataFrame, provenance: str) -> DataFrame:
    have = set(rows.columns)
    line = F.col("line") if "line" in have else F.lit(None).cast("int")
    return rows.select("seq", "from_id", "to_id", "kind", F.lit(provenance).alias("provenance"), F.lit(None).cast("double").alias("confidence"), line.alias("line")).filter("from_id <> to_id").groupBy("from_id", "to_id", "kind", "provenance").agg(F.min("seq").alias("seq"), F.first("confidence").alias("confidence"), F.min("line").alias("line")).select(COLUMNS)


def _members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, name, method): of methods of one name in an owner, the last defined."""
    m = edges.filter(F.col("kind") == "Defines").select(F.col("from_id").alias("owner"), F.col("to_id").alias("id"), F.col("seq").alias("def_seq")).join(nodes.filter(F.col("kind") == "Method").select("id", "name"), "id")
    return m.groupBy("owner", "name").agg(F.max_by("id", "def_seq").alias("method"))


def dispatch_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Overrides of a direct supertype's methods by name, and calls fanned out to the same method of direct subtypes.

    Edges that call resolution derives never take part, so an incremental run gives what a full one does.
    """
    base = edges.filter(~F.col("provenance").eqNullSafe("call") & ~F.col("provenance").eqNullSafe("dispatch"))
    members = _members(nodes, base)
    types = base.filter(F.col("kind").isin("Inherits", "Implements")).select(F.col("from_id").alias("sub"), F.col("to_id").alias("super"), F.col("seq").alias("type_seq"))
    sub = types.join(members.select(F.col("owner").alias("sub"), "name", F.col("method").alias("sub_method")), "sub")
    both = sub.join(members.select(F.col("owner").alias("super"), "name", F.col("method").alias("super_method")), ["super", "name"])
    overrides = both.select(F.col("type_seq").alias("seq"), F.col("sub_method").alias("from_id"), F.col("super_method").alias("to_id"), F.lit("Overrides").alias("kind"))
    owners = base.filter(F.col("kind") == "Defines").select(F.col("from_id").alias("super"), F.col("to_id").alias("callee")).join(nodes.filter(F.col("kind").isin("Class", "Interface")).select(F.col("id").alias("super")), "super", "left_semi")
    called = base.filter(F.col("kind") == "Calls").select("seq", "from_id", F.col("to_id").alias("callee")).join(nodes.filter(F.col("kind") == "Method").select(F.col("id").alias("callee"), "name"), "callee").join(owners, "callee")
    fanned = called.join(sub.select("super", "name", "sub_method"), ["super", "name"]).select("seq", "from_id", F.col("sub_method").alias("to_id"), F.lit("Calls").alias("kind"))
    return _edges(overrides.unionByName(fanned), "dispatch")


def _by_scope(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Candidates (seq, from_id, name, kind, file) joined to definitions: same file, same directory (Java), imported files in order,
    imported directories; within a place the first definition wins."""
    defs = nodes.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("to_id"), simple_name(F.col("name")).alias("name"), F.col("file").alias("def_file"), F.col("seq").alias("def_seq"))
    first = defs.groupBy("name", "def_file").agg(F.min_by("to_id", "def_seq").alias("to_id"), F.min("def_seq").alias("def_seq"))
    imports = edges.filter(F.col("kind").isin("Imports", "ImportsType")).join(nodes.select(F.col("id").alias("to_id"), F.col("file").alias("import_file")), "to_id", "left").select(F.col("from_id").alias("file"), F.coalesce("import_file", "to_id").alias("target"), F.col("import_file").isNull().alias("is_dir"), F.col("seq").alias("import_seq"))
    zero = F.lit(0).cast("long")
    same = candidates.join(first, [candidates["name"] == first["name"], candidates["file"] == first["def_file"]]).select(candidates["*"], "to_id", "def_seq", F.lit(0).alias("prio"), zero.alias("import_seq"))
    java = F.col("file").endswith(".java") & F.col("def_file").endswith(".java")
    f2 = first.withColumnRenamed("name", "def_name").withColumn("def_dir", dirname(F.col("def_file")))
    near = candidates.withColumn("dir", dirname(F.col("file"))).join(f2, (F.col("name") == F.col("def_name")) & (F.col("dir") == F.col("def_dir"))).filter(java).select(*candidates.columns, "to_id", "def_seq", F.lit(1).alias("prio"), zero.alias("import_seq"))
    through = candidates.join(imports, "file")
    by_file = through.filter("not is_dir").join(f2, (F.col("name") == F.col("def_name")) & (F.col("target") == F.col("def_file"))).select(*candidates.columns, "to_id", "def_seq", F.lit(2).alias("prio"), "import_seq")
    by_dir = through.filter("is_dir").join(f2, (F.col("name") == F.col("def_name")) & (F.col("target") == F.col("def_dir"))).select(*candidates.columns, "to_id", "def_seq", F.lit(3).alias("prio"), "import_seq")
    every = same.unionByName(near).unionByName(by_file).unionByName(by_dir).filter("from_id <> to_id")
    order = Window.partitionBy("seq", "from_id", "name", "kind").orderBy("prio", "import_seq", "def_seq")
    return every.withColumn("rn", F.row_number().over(order)).filter("rn = 1")


def _candidates(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    found = edges.filter(F.startswith("to_id", F.lit(prefix))).select("seq", "from_id", F.expr(f"substring(to_id, {len(prefix) + 1})").alias("name"), "kind")
    return found.join(nodes.select(F.col("id").alias("from_id"), "file"), "from_id").withColumn("name", simple_name(F.col("name"))).select("seq", "from_id", "name", "kind", "file")


def type_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _edges(_by_scope(nodes, edges, _candidates(nodes, edges, "type:"), ("Class", "Interface", "Enum", "TypeAlias")), "type")


def call_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = _by_scope(nodes, edges, _candidates(nodes, edges, "call:"), ("Function", "Method"))
    return _edges(found.withColumn("kind", F.lit("Calls")), "call")


def prisma_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References to models and fields, by lower-cased name; the last definition wins."""
    schema = nodes.filter(F.lower("file").endswith(".prisma"))
    models = schema.filter(F.col("kind") == "Class").select(F.concat(F.lit("prisma:model:"), F.lower("name")).alias("key"), "id", "seq")
    fields = schema.filter(F.col("kind") == "Property").select(F.concat(F.lit("prisma:field:"), F.lower("qualified_name")).alias("key"), "id", "seq")
    known = models.unionByName(fields).groupBy("key").agg(F.max_by("id", "seq").alias("target"))
    found = edges.filter(F.startswith("to_id", F.lit("prisma:"))).withColumn("key", F.lower("to_id")).join(known, "key")
    return _edges(found.select("seq", "from_id", F.col("target").alias("to_id"), F.lit("References").alias("kind")), "prisma")


def route_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests ``route:VERB path`` joined to routes: equal numbers of segments, ``:x`` and ``*`` match any; a verb's own routes
    before ANY, then the first.

    Routes of one pattern count as their first, and requests are joined by the few shapes (which segments match any) that a verb's routes
    of their length have: a request's path, with these segments left out, equals the pattern of every route of the shape that fits.
    """
    split = lambda c: (F.upper(F.substring_index(c, " ", 1)), segments(F.expr(f"substring({c}, instr({c}, ' ') + 1)")))
    verb, segs = split("name")
    free = lambda s: F.startswith(s, F.lit(":")) | (s == "*")
    routes = nodes.filter(F.col("kind") == "Route").select(F.col("id").alias("route"), F.col("seq").alias("route_seq"), verb.alias("route_verb"), segs.alias("segs"))
    routes = routes.withColumn("shape", F.transform("segs", free)).withColumn("pattern", F.transform("segs", lambda s: F.when(free(s), ":").otherwise(s)))
    routes = routes.groupBy("route_verb", "shape", "pattern").agg(F.min(F.struct("route_seq", "route")).alias("first"))
    shapes = routes.select("route_verb", "shape").distinct().withColumn("n", F.size("shape"))
    asked = edges.filter(F.startswith("to_id", F.lit("route:"))).select("seq", "from_id", F.expr("substring(to_id, 7)").alias("asked"))
    verb, segs = split("asked")
    each = asked.select("asked").distinct().select("asked", verb.alias("verb"), segs.alias("path")).withColumn("n", F.size("path")).withColumn("route_verb", F.explode(F.array_distinct(F.array("verb", F.lit("ANY")))))
    each = each.join(F.broadcast(shapes), ["route_verb", "n"]).withColumn("pattern", F.zip_with("path", "shape", lambda p, open_: F.when(open_, ":").otherwise(p)))
    best = F.min(F.struct((F.col("route_verb") == "ANY").alias("any"), "first")).alias("best")
    found = asked.join(each.join(routes, ["route_verb", "shape", "pattern"]).groupBy("asked").agg(best), "asked").groupBy("seq", "from_id").agg(F.min("best")["first"]["route"].alias("to_id"))
    return _edges(found.select("seq", "from_id", "to_id", F.lit("References").alias("kind")), "route-test")


def env_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.filter((F.col("kind") == "Variable") & F.col("file").endswith(".env")).select(F.concat(F.lit("env:"), F.col("name")).alias("key"), "id", "seq").groupBy("key").agg(F.max_by("id", "seq").alias("target"))
    found = edges.filter(F.col("provenance").eqNullSafe("env-ref")).join(known, F.col("to_id") == F.col("key"))
    return _edges(found.select("seq", "from_id", F.col("target").alias("to_id"), F.lit("References").alias("kind")), "env")


def derive_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Base edges and all derived ones, deduplicated with base edges first. Dispatch sees type edges, nothing else derived."""
    base = edges.filter(F.coalesce("provenance", F.lit("")).isin("dispatch", "call", "type", "prisma", "route-test", "env") == F.lit(False)).select(COLUMNS)
    types = materialize(type_edges(nodes, base))
    every = base
    for i, d in enumerate((types, dispatch_edges(nodes, base.unionByName(types)), call_edges(nodes, base), prisma_edges(nodes, base), route_edges(nodes, base), env_edges(nodes, base))):
        every = every.unionByName(d.withColumn("seq", F.col("seq") + F.lit((i + 1) * 10**17)))
    return dedup_edges(every).select(COLUMNS)
