"""Reference resolution and one-hop relations: one join template, and a table of directions and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_deprioritized
from ..graph import Graph
from ..plans.durable import materialize

# fixed values: what each relation follows; "in" goes from targets to what points at them
RELATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "callers": ("in", ("Calls", "Instantiates")), "callees": ("out", ("Calls", "Instantiates")), "handlers": ("out", ("References",)), "referrers": ("in", ("References",)), "routes": ("in", ("References",)),
    "overrides": ("out", ("Overrides",)), "overridden_by": ("in", ("Overrides",)), "implementations": ("in", ("Implements",)), "interfaces": ("out", ("Implements",)), "importers": ("in", ("Imports", "ImportsType")),
    "imports": ("out", ("Imports", "ImportsType")), "type_users": ("in", ("UsesType", "Returns")), "types_used": ("out", ("UsesType", "Returns")), "returns": ("out", ("Returns",)),
}
# fixed values: relevance of node kinds
KIND_BONUS = {"Class": 8, "Interface": 8, "Function": 8, "Enum": 6, "TypeAlias": 6, "Module": 6, "Route": 4, "Method": 2, "Property": 1, "Variable": 1}


def kind_bonus(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in KIND_BONUS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def plain_score() -> Column:
    """Relevance without a search text."""
    return kind_bonus(F.col("kind")) - F.when(is_deprioritized(F.col("file")), 50).otherwise(0)


def resolve(graph: Graph, ref: str) -> DataFrame:
    """Nodes that a reference means: by id, else by name, else by qualified name and its overloads. ``ord`` keeps their order.

    All tiers are one filtered scan; the least tier that has a node wins.
    """
    qn = F.col("qualified_name")
    tier = F.when(F.col("id") == ref, 0).when(F.col("name") == ref, 1).when(qn == ref, 2).when(F.startswith(qn, F.lit(ref + "(")), 3)
    found = materialize(graph.nodes.withColumn("tier_", tier).filter(F.col("tier_").isNotNull()))
    best = found.agg(F.least(F.min("tier_"), F.lit(2)).alias("best"))  # exact and overloaded names are one tier
    return found.join(F.broadcast(best), F.least(F.col("tier_"), F.lit(2)) == F.col("best")).drop("best").withColumn("ord", F.col("tier_") * F.lit(10**16) + F.col("seq")).drop("tier_")


def tier_of(graph: Graph, ref: str) -> DataFrame:
    """The analysis tier of the first node that a reference means, as one row or none."""
    return resolve(graph, ref).orderBy("ord").limit(1).select("id", "tier")


def narrowed(table: DataFrame, column: str, wanted: DataFrame, key: str, few: int = 1000) -> DataFrame:
    """``table`` with a filter on ``column`` that reaches its files, if ``wanted`` has at most ``few`` keys (which are fetched)."""
    keys = [r[0] for r in wanted.select(key).distinct().limit(few + 1).collect()]
    return table if len(keys) > few else table.filter(F.col(column).isin(keys) if keys else F.lit(False))


def neighbors(graph: Graph, targets: DataFrame, direction: str, kinds: tuple[str, ...]) -> DataFrame:
    """Nodes one edge away from ``targets`` (id, ord), each once: by target, then kind, then edge, the first wins."""
    near, far = ("to_id", "from_id") if direction == "in" else ("from_id", "to_id")
    e = narrowed(graph.adjacent(direction).filter(F.col("kind").isin(*kinds)), near, targets, "id")
    rank = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("via"))
    hops = targets.select(F.col("id").alias(near), "ord").join(e, near).select("ord", F.col(far).alias("id"), F.col("kind").alias("via"), F.col("seq").alias("edge_seq"), *[c for c in ("provenance", "confidence", "line") if c in e.columns])
    found = hops.join(narrowed(graph.nodes, "id", hops, "id"), "id")
    first = Window.partitionBy("id").orderBy("ord", rank, "edge_seq")
    return found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "ord", "edge_seq")


def relation(graph: Graph, ref: str, name: str) -> DataFrame:
    """The named relation of a reference, with relevance; order by score descending, qualified name, seq for display."""
    return neighbors(graph, resolve(graph, ref), *RELATIONS[name]).withColumn("score", plain_score())


def defined_by(graph: Graph, id: str) -> DataFrame:
    """Members in source order (``position`` from 1)."""
    found = graph.edges.filter((F.col("kind") == "Defines") & (F.col("from_id") == id)).select(F.col("to_id").alias("id"), F.col("seq").alias("edge_seq")).join(graph.nodes, "id")
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.coalesce("start_line", F.lit(0)), "edge_seq"))).drop("edge_seq")


def file_of(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.col("id").alias("to_id"), F.col("file").alias("to_file"))


def file_importers(graph: Graph, file_id: str | None = None) -> DataFrame:
    """(file, importer): nodes that import the file, or a symbol that the file directly defines."""
    own = graph.nodes.filter(F.col("kind") == "File").select(F.col("id").alias("file"), F.col("id").alias("to_id"))
    members = graph.edges.filter(F.col("kind") == "Defines").select(F.col("from_id").alias("file"), "to_id").join(own.select("file"), "file", "left_semi")
    targets = own.unionByName(members)
    if file_id is not None:
        targets = targets.filter(F.col("file") == file_id)
    e = graph.edges.filter(F.col("kind").isin("Imports", "ImportsType")).select("to_id", F.col("from_id").alias("importer"))
    return targets.join(e, "to_id").select("file", "importer").distinct()


def file_imports(graph: Graph) -> DataFrame:
    """(file, imported): distinct files that a File imports (value imports only), itself left out."""
    e = graph.edges.filter(F.col("kind") == "Imports").select(F.col("from_id").alias("file"), "to_id")
    files = graph.nodes.filter(F.col("kind") == "File").select(F.col("id").alias("file"))
    return e.join(files, "file", "left_semi").join(file_of(graph), "to_id").filter(F.col("file") != F.col("to_file")).select("file", F.col("to_file").alias("imported")).distinct()


def skeleton(graph: Graph, file_id: str, cap: int = 25) -> DataFrame:
    """One row per part of a file: members in order, what it imports, and up to ``cap`` dependents (the total is kept)."""
    members = defined_by(graph, file_id).select(F.lit("member").alias("part"), "position", F.col("id").alias("symbol"), F.lit(None).cast("long").alias("total"))
    imports = file_imports(graph).filter(F.col("file") == file_id).select(F.lit("import").alias("part"), F.lit(None).cast("int").alias("position"), F.col("imported").alias("symbol"), F.lit(None).cast("long").alias("total"))
    inside = graph.nodes.filter((F.col("file") == file_id) | (F.col("id") == file_id)).select(F.col("id").alias("to_id"))
    who = graph.edges.filter(F.col("kind") == "Imports").join(inside, "to_id", "left_semi").select(F.col("from_id").alias("id")).filter(F.col("id") != file_id).distinct().join(graph.nodes, "id").withColumn("score", plain_score())
    order = Window.orderBy(F.desc("score"), "qualified_name", "id")
    dependents = who.withColumns({"position": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy())}).filter(F.col("position") <= cap)
    return members.unionByName(imports).unionByName(dependents.select(F.lit("dependent").alias("part"), "position", F.col("id").alias("symbol"), "total"))


def external_supertypes(graph: Graph, id: str) -> DataFrame:
    """Names of supertypes that stayed unresolved: candidates ``type:X`` without a resolved edge to an X."""
    e = graph.edges.filter((F.col("from_id") == id) & F.col("kind").isin("Inherits", "Implements"))
    candidates = e.filter(F.startswith("to_id", F.lit("type:"))).select(F.expr("substring(to_id, 6)").alias("name")).distinct()
    resolved = e.select(F.col("to_id").alias("id")).join(graph.nodes, "id").select("name").distinct()
    return candidates.join(resolved, "name", "left_anti")


def node_view(graph: Graph, ref: str) -> DataFrame:
    """The first match and its relations by id, so that same-named symbols do not mix; other matches as alternatives."""
    matches = resolve(graph, ref).withColumn("rn", F.row_number().over(Window.orderBy("ord")))
    primary = matches.filter("rn = 1")
    out = matches.select(F.when(F.col("rn") == 1, "self").otherwise("alternative").alias("relation"), "id")
    for name in ("callers", "callees", "implementations", "interfaces", "referrers", "overrides", "overridden_by"):
        out = out.unionByName(neighbors(graph, primary.select("id", "ord"), *RELATIONS[name]).select(F.lit(name).alias("relation"), "id"))
    members = graph.edges.filter(F.col("kind") == "Defines").join(primary.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.lit("member").alias("relation"), F.col("to_id").alias("id"))
    return out.unionByName(members)
