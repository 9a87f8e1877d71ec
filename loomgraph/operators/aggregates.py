"""Counts, histograms, dedup, statistics and the portable export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex, language
from ..graph import Graph
from ..schemas import PROVENANCES, STRATEGIES

# fixed values: edge kinds that the export reports as references
REFERENCE_KINDS = ("Calls", "References", "UsesType", "Returns", "Instantiates", "Implements", "Inherits", "Overrides", "Imports", "ImportsType")


def schema_census(graph: Graph) -> DataFrame:
    """(facet, value, n): nodes by kind; edges whose source exists by kind, provenance (absent: resolved) and strategy, zeros filled in."""
    e = graph.edges.join(graph.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    strategy = F.col("strategy") if "strategy" in graph.edges.columns else F.lit(None).cast("string")
    e = e.groupBy("kind", F.coalesce("provenance", F.lit("resolved")).alias("provenance"), strategy.alias("strategy")).agg(F.count("*").alias("n"))
    # one pass over the edges; a few counts are then told apart by facet
    facet = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("edge_kind", "kind"), ("provenance", "provenance"), ("strategy", "strategy")))))
    rows = e.select("n", facet.alias("f")).select("f.*", "n").filter("value is not null")
    rows = rows.unionByName(graph.nodes.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("node_kind")))
    known = [("provenance", v) for v in PROVENANCES] + [("strategy", v) for v in STRATEGIES]
    zeros = graph.nodes.sparkSession.createDataFrame(known, "facet string, value string").withColumn("n", F.lit(0).cast("long"))
    return rows.unionByName(zeros).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def top_and_other(counts: DataFrame, name: str = "name", cap: int = 100) -> DataFrame:
    """The ``cap`` largest counts (ties by name) and the rest folded into one row named null."""
    top = counts.orderBy(F.desc("n"), name).limit(cap).select(F.col(name).alias("name"), F.col("n").cast("long").alias("n"))
    rest = counts.agg(F.sum("n").alias("all")).crossJoin(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))).select(F.lit(None).cast("string").alias("name"), (F.coalesce("all", F.lit(0)) - F.col("kept")).cast("long").alias("n"))
    return top.unionByName(rest)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row for each (from, to, kind): the highest confidence, else the first; it takes the first row's place, and what it lacks
    comes from the next best."""
    key = ["from_id", "to_id", "kind"]
    best = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("seq")).alias("s"))
    rest = [c for c in edges.columns if c not in (*key, "seq")]
    return edges.groupBy(*key).agg(F.min("seq").alias("seq"), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), best)).alias(c) for c in rest))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the last written, in the first one's place."""
    rest = [c for c in nodes.columns if c not in ("id", "seq")]
    return nodes.groupBy("id").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("v")).select("id", "seq", "v.*")


def call_sites(sites: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, line, column, n_sites, sites): the first site, and all of them only if there are several."""
    each = F.sort_array(F.collect_list(F.struct("seq", "line", "column")))
    grouped = sites.groupBy("from_id", "to_id", "kind").agg(each.alias("all"))
    listed = F.when(F.size("all") > 1, F.transform("all", lambda s: F.struct(s["line"].alias("line"), s["column"].alias("column"))))
    return grouped.select("from_id", "to_id", "kind", F.col("all")[0]["line"].alias("line"), F.col("all")[0]["column"].alias("column"), F.size("all").alias("n_sites"), listed.alias("sites"))


def language_census(graph: Graph, files: DataFrame) -> DataFrame:
    """(language, files, tier): the tier of the language's first File node."""
    known = files.withColumn("language", language(F.col("path"))).filter("language is not null")
    tiers = graph.nodes.filter(F.col("kind") == "File").select(F.col("id").alias("path"), "tier", "seq")
    return known.join(tiers, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.min_by("tier", "seq").alias("tier"))


def merge_resolution(stats: DataFrame) -> DataFrame:
    """Sums of (calls_total, calls_resolved) and of the per-name map ``unresolved`` over analyzers, as one row."""
    names = stats.select(F.explode("unresolved").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
    merged = names.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("unresolved"))
    return stats.agg(F.sum("calls_total").alias("calls_total"), F.sum("calls_resolved").alias("calls_resolved")).crossJoin(merged)


def resolution_rate(stats: DataFrame) -> DataFrame:
    return stats.withColumn("rate", F.when(F.col("calls_total") > 0, F.col("calls_resolved") / F.col("calls_total")))


RANGE = "struct<startLine:int,endLine:int>"
DOCUMENT = f"path string, symbols array<struct<symbol:string,kind:string,name:string,range:{RANGE}>>, occurrences array<struct<symbol:string,role:string,range:{RANGE}>>"


def _export_rows(graph: Graph) -> DataFrame:
    """(path, part, seq, symbol, kind, name, range): definitions (part 0), and references (1) by edges that leave a file's symbols, whether
    their target exists or not."""
    span = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").cast("int").alias("startLine"), F.col("end_line").cast("int").alias("endLine")))
    kinds = F.col("kind").isin(*REFERENCE_KINDS)
    none = F.lit(None)
    symbols = graph.nodes.filter(F.col("kind") != "File").select(F.col("file").alias("path"), F.lit(0).alias("part"), "seq", F.col("id").alias("symbol"), "kind", "name", span.alias("range"))
    home = graph.nodes.select(F.col("id").alias("from_id"), F.col("file").alias("path"))
    refs = graph.edges.filter(kinds).join(home, "from_id").select("path", F.lit(1).alias("part"), "seq", F.col("to_id").alias("symbol"), none.cast("string").alias("kind"), none.cast("string").alias("name"), none.cast(RANGE).alias("range"))
    return symbols.unionByName(refs)


def _documents(rows: DataFrame, *by: str) -> DataFrame:
    """(by, document): the rows of each group as one JSON text, in order."""
    listed = F.sort_array(F.collect_list(F.struct("part", "seq", "symbol", "kind", "name", "range")))
    defined = F.transform(F.filter("rows", lambda r: r["part"] == 0), lambda r: F.struct(r["symbol"].alias("symbol"), r["kind"].alias("kind"), r["name"].alias("name"), r["range"].alias("range")))
    role = lambda r: F.when(r["part"] == 0, "definition").otherwise("reference")
    occurring = F.transform("rows", lambda r: F.struct(r["symbol"].alias("symbol"), role(r).alias("role"), r["range"].alias("range")))
    return rows.groupBy(*by).agg(listed.alias("rows")).select(*by, F.to_json(F.struct("path", defined.alias("symbols"), occurring.alias("occurrences"))).alias("document"))


def export_documents(graph: Graph) -> DataFrame:
    """(path, document): the portable export, one JSON text a file, with its symbols and all occurrences in it: definitions in order, then
    references. A file's text is one value, which a task holds whole; :func:`export_pieces` is for files of any size."""
    return _documents(_export_rows(graph), "path")


def export_pieces(graph: Graph, size: int = 1000) -> DataFrame:
    """(path, piece, document): the same export in pieces of at most ``size`` occurrences, each a JSON text of a document's form. The
    symbols and occurrences of a path's pieces, one piece after another, are those of its document. A path may spread over many tasks."""
    order = ["path", "part", "seq", "symbol"]
    rows = _export_rows(graph).repartitionByRange(*order).sortWithinPartitions(*order, "kind", "name", "range")
    place = F.monotonically_increasing_id()  # rises along the whole order: a task's number, then the place in it
    return _documents(rows.withColumn("piece", F.floor(place / F.lit(size))), "path", "piece")


def export_index(graph: Graph, root: str, path: str) -> None:
    """Writes the export below ``path``: the documents in order, one a line, and a header with version and root."""
    export_documents(graph).orderBy("path").select("document").write.mode("overwrite").text(f"{path}/documents")
    header = graph.nodes.sparkSession.createDataFrame([("0.1", root)], "version string, root string")
    header.coalesce(1).write.mode("overwrite").json(f"{path}/index")


def overloads(methods: DataFrame) -> DataFrame:
    return methods.groupBy("owner", "name").agg(F.countDistinct("descriptor").alias("overloads"))


def members_by_file(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("file").agg(F.count("*").alias("n"), F.min(F.struct("seq", "id"))["id"].alias("first"))




def counts(graph: Graph) -> DataFrame:
    """One row: nodes and edges."""
    return graph.nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))


def listed_files(files: DataFrame, part: str | None = None, glob: str | None = None) -> DataFrame:
    """Files (path) that hold a substring, or match a glob over whole paths."""
    if part:
        files = files.filter(F.contains("path", F.lit(part)))
    return files.filter(F.col("path").rlike(glob_regex(glob))) if glob else files


def project_of(projects: DataFrame, path: str) -> DataFrame:
    """The project (project, root) whose root is or contains the path; of several, the longest root."""
    here = F.lit(path)
    inside = projects.filter((F.col("root") == here) | F.startswith(here, F.concat("root", F.lit("/"))))
    return inside.orderBy(F.desc(F.length("root"))).limit(1)


def saved_share(runs: DataFrame) -> DataFrame:
    """Totals of benchmark rows (calls, tokens, base_calls, base_tokens), and the shares saved in percent."""
    names = ("calls", "tokens", "base_calls", "base_tokens")
    totals = runs.agg(*(F.sum(c).alias(c) for c in names))
    return totals.withColumns({f"{c}_saved": F.round((1 - F.col(c) / F.col(f"base_{c}")) * 100, 3) for c in ("calls", "tokens")})
