"""The engine's front door: index a source tree, keep it up to date, and ask about it.

A session holds projects, each a root folder and its stored graph. Methods are named as the tools they stand for; those that list
something give DataFrames, those that state something give plain values. Results are fetched by whoever consumes them.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import language
from .graph import Graph
from .operators import aggregates, derive, maintain, relations, search, traversal
from .plans.durable import materialize
from .sources import extract, walk

DERIVED = ("dispatch", "call", "type", "prisma", "route-test", "env")
NOTE = "baseline analysis: names are bound by imports, not by a type checker"


@dataclass
class Project:
    root: str
    path: str  # of the stored graph
    graph: Graph


def stored_at(root: str) -> str:
    """Where a root's graph lies: LOOMGRAPH_STORE if set, else a folder in the root that no walk enters."""
    return os.environ.get("LOOMGRAPH_STORE") or f"{root}/.loomgraph"


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.projects = spark, {}

    # -- indexing

    def _extracted(self, root: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        files = materialize(walk.contents(self.spark, root, wanted))
        return extract.extract_files(files)

    def _save(self, root: str, graph: Graph, errors: int) -> Project:
        path = stored_at(root)
        graph = Graph(materialize(graph.nodes), materialize(graph.edges), None, materialize(graph.files))
        meta = {"root": root, "nodes": str(graph.nodes.count()), "edges": str(graph.edges.count()), "errors": str(errors)}
        maintain.save(graph, path, meta)
        return self.open(root)

    def index_repository(self, root: str) -> dict:
        """Walk, extract, derive and store a tree as a new version; readers of the old one are not disturbed."""
        root = walk.assert_safe_root(root)
        found = materialize(walk.discover(self.spark, root))
        wanted = found.filter("not oversize")
        nodes, edges, errors = self._extracted(root, wanted)
        edges = derive.derive_all(nodes, edges)
        failed = errors.count()
        self._save(root, Graph(nodes, edges, None, self._files(root, wanted)), failed)
        return self.index_status(root) | {"oversize": found.filter("oversize").count(), "errors": failed}

    def _files(self, root: str, wanted: DataFrame) -> DataFrame:
        hashes = walk.contents(self.spark, root, wanted).select("path", "hash")
        return wanted.join(hashes, "path").select("path", "size", "mtime_ms", "hash", F.coalesce(language(F.col("path")), "kind").alias("language"))

    def open(self, root: str) -> Project | None:
        """The stored graph of a root, if it is complete and states the same schema, root and number of nodes."""
        root = os.path.abspath(root)
        loaded = maintain.load(self.spark, stored_at(root), root)
        if loaded is None:
            return None
        self.projects[root] = Project(root, stored_at(root), loaded[0])
        return self.projects[root]

    def _changed(self, project: Project) -> tuple[DataFrame, DataFrame]:
        """(current files, path and change): size and time decide first, and the hash of those files only that they leave open."""
        current = materialize(walk.discover(self.spark, project.root).filter("not oversize"))
        stored = project.graph.files
        same = current.join(stored.select("path", "size", "mtime_ms", "hash"), ["path", "size", "mtime_ms"])
        rest = current.join(same.select("path"), "path", "left_anti")
        hashes = walk.contents(self.spark, project.root, rest).select("path", "hash")
        now = same.select("path", "size", "mtime_ms", "hash").unionByName(rest.join(hashes, "path").select("path", "size", "mtime_ms", "hash"))
        return current, materialize(maintain.stale(stored, materialize(now)))

    def sync_index(self, root: str) -> dict[str, list[str]]:
        """Take over what has changed on disk since the last index."""
        project = self._project(root)
        current, changes = self._changed(project)
        rows = changes.collect()  # paths that changed between two syncs
        if rows:
            self._update(project, current, changes.select("path"))
        return {"changed": sorted(r["path"] for r in rows if r["change"] != "removed"), "removed": sorted(r["path"] for r in rows if r["change"] == "removed")}

    def reindex_file(self, root: str, path: str) -> dict:
        """Take over one file, changed, added or gone."""
        project = self._project(root)
        current = walk.discover(self.spark, project.root).filter("not oversize")
        self._update(project, current, self.spark.createDataFrame([(path,)], "path string"))
        return self.index_status(project.root)

    def _update(self, project: Project, current: DataFrame, paths: DataFrame) -> None:
        graph = project.graph
        wanted = current.join(paths, "path", "left_semi")
        nodes, edges, errors = self._extracted(project.root, wanted)
        base = graph.edges.filter(~F.coalesce("provenance", F.lit("")).isin(*DERIVED))
        # new rows come after all old ones, file by file; what a full index would bind across files is bound anew
        last = graph.nodes.agg(F.max("seq")).first()[0] or 0
        nodes, edges = (x.withColumn("seq", F.col("seq") + F.lit((last >> 16 << 16) + 65536)) for x in (nodes, edges))
        kept, kept_edges = maintain.reconcile(graph.nodes, base, paths, nodes.select(graph.nodes.columns), edges.select(base.columns))
        files = graph.files.join(paths, "path", "left_anti").unionByName(self._files(project.root, wanted))
        self._save(project.root, Graph(kept, derive.derive_all(kept, kept_edges), None, files), errors.count())

    def remove_index(self, root: str) -> None:
        maintain.remove(self.spark, stored_at(os.path.abspath(root)))
        self.projects.pop(os.path.abspath(root), None)

    def index_status(self, root: str) -> dict:
        project = self._project(root)
        n = aggregates.counts(project.graph).first()
        languages = {r["language"]: (r["files"], r["tier"]) for r in aggregates.language_census(project.graph, project.graph.files).collect()}
        return {"root": project.root, "nodes": n["nodes"], "edges": n["edges"], "files": project.graph.files.count(), "languages": languages}

    def list_projects(self) -> list[str]:
        return sorted(self.projects)

    def _project(self, path: str | None = None) -> Project:
        """The project of a path: the one with the longest root that holds it; without a path the only one."""
        if path is None:
            if len(self.projects) != 1:
                raise ValueError(f"name a project: {self.list_projects()}")
            return next(iter(self.projects.values()))
        full = os.path.abspath(path)
        inside = [r for r in self.projects if full == r or full.startswith(r.rstrip("/") + "/")]
        if not inside and self.open(full) is not None:
            inside = [full]
        if not inside:
            raise ValueError(f"{full} is not indexed")
        return self.projects[max(inside, key=len)]

    def graph(self, root: str | None = None, sources: bool = False) -> Graph:
        project = self._project(root)
        if not sources:
            return project.graph
        text = walk.contents(self.spark, project.root, project.graph.files)  # read at query time: a file that is gone drops out
        lines = text.select("path", F.split(F.decode("content", "UTF-8"), "\n").alias("lines"))
        return Graph(project.graph.nodes, project.graph.edges, lines, project.graph.files, project.graph.incoming)

    # -- questions; every one takes ``root`` where several projects are open

    def search_symbol(self, query: str, limit: int = 50, kind: str | None = None, exact: bool = False, root: str | None = None) -> dict:
        hits, unsure = search.search_symbols_with_confidence(self.graph(root), query, limit + 1, kind, exact)
        return capped(hits, limit) | {"low_confidence": unsure}

    def search_code(self, query: str, limit: int = 50, root: str | None = None) -> dict:
        found, by_terms = search.search_code_with_confidence(search.bodies(self.graph(root, sources=True)), query, limit + 1)
        return capped(found, limit) | {"via_terms": by_terms}

    def _relation(self, name: str, ref: str, root: str | None) -> DataFrame:
        return relations.relation(self.graph(root), ref, name).orderBy(F.desc("score"), "qualified_name", "seq")

    def find_callers(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("callers", ref, root)

    def find_callees(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("callees", ref, root)

    def find_handlers(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("handlers", ref, root)

    def find_referrers(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("referrers", ref, root)

    def find_routes(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("routes", ref, root)

    def find_overrides(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("overrides", ref, root)

    def find_overridden_by(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("overridden_by", ref, root)

    def find_implementations(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("implementations", ref, root)

    def find_interfaces(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("interfaces", ref, root)

    def find_importers(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("importers", ref, root)

    def find_imports(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("imports", ref, root)

    def find_type_users(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("type_users", ref, root)

    def find_types_used(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("types_used", ref, root)

    def find_returns(self, ref: str, root: str | None = None) -> DataFrame:
        return self._relation("returns", ref, root)

    def get_code_snippet(self, ref: str, root: str | None = None) -> dict | None:
        row = search.snippet(self.graph(root, sources=True), relations.resolve(self.graph(root), ref)).first()
        return row.asDict() if row else None

    def node(self, ref: str, root: str | None = None) -> dict:
        """Everything one step from a symbol, and how far the analysis of its file can be trusted."""
        view = relations.node_view(self.graph(root), ref).collect()
        out: dict = {}
        for r in view:
            out.setdefault(r["relation"], []).append(r["id"])
        tier = relations.tier_of(self.graph(root), ref).first()
        return out | ({"tier": "baseline", "authoritative": False, "note": NOTE} if tier and tier["tier"] == "baseline" else {})

    def file_skeleton(self, path: str, root: str | None = None) -> DataFrame:
        return relations.skeleton(self.graph(root), path)

    def impact_analysis(self, ref: str, max_depth: int | None = None, root: str | None = None) -> DataFrame:
        graph = self.graph(root)
        return traversal.impact(graph, relations.resolve(graph, ref), max_depth)

    def affected(self, files: list[str], tests_only: bool = False, glob: str | None = None, root: str | None = None) -> DataFrame:
        found = traversal.affected_files(self.graph(root), files, tests_only)
        return aggregates.listed_files(found.withColumnRenamed("file", "path"), glob=glob)

    def circular_imports(self, root: str | None = None) -> DataFrame:
        return traversal.circular_imports(self.graph(root))

    def explore(self, question: str, limit: int = 15, root: str | None = None) -> DataFrame:
        return traversal.explore(self.graph(root), question, limit)

    def get_graph_schema(self, root: str | None = None) -> DataFrame:
        return aggregates.schema_census(self.graph(root))

    def export_code_intel(self, root: str | None = None) -> DataFrame:
        return aggregates.export_documents(self.graph(root))

    def files(self, part: str | None = None, root: str | None = None) -> DataFrame:
        return aggregates.listed_files(self.graph(root).files, part).orderBy("path")


def capped(results: DataFrame, limit: int) -> dict:
    """At most ``limit`` of results that were asked for with one more, and whether there are more."""
    rows = results.collect()  # limit + 1 rows
    return {"results": rows[:limit], "truncated": len(rows) > limit}


def rendered(results: DataFrame) -> str:
    """Results as one JSON text a line, for a terminal or a pipe."""
    return "\n".join(json.dumps(json.loads(r), ensure_ascii=False) for r in results.toJSON().toLocalIterator())
