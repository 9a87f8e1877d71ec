"""Fixpoints over edges: blast radius, affected files, import cycles, exploration."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_test_file
from ..graph import Graph
from ..plans.durable import materialize
from .relations import RELATIONS, file_importers, file_imports, narrowed, plain_score, resolve
from .search import search_symbols, search_terms, terms_of

# fixed values: edges along which a change spreads
IMPACT_KINDS = ("Calls", "References", "UsesType", "Returns", "Instantiates", "Implements", "Inherits", "Overrides")


def reach(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth) reachable along ``steps`` (src, dst) from ``seeds`` (seed, id), all seeds in one loop.

    Each level joins the frontier alone and is written down, so lineage stays short and a lost executor costs one level.
    """
    seen = materialize(seeds.select("seed", "id", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        following = frontier.select("seed", F.col("id").alias("src")).join(steps, "src").select("seed", F.col("dst").alias("id")).distinct()
        frontier = materialize(following.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(graph: Graph, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that a change of ``targets`` (id) can reach, with their depth; targets themselves are left out."""
    steps = graph.edges.filter(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).distinct()
    steps = steps.join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")  # a missing node is not passed through
    seeds = targets.select(F.lit(0).alias("seed"), "id")
    return reach(materialize(steps), seeds, max_depth).filter("depth > 0").select("id", "depth").join(graph.nodes, "id")


def affected_files(graph: Graph, files: list[str], tests_only: bool = False) -> DataFrame:
    """Files that import the given files, directly or not."""
    steps = file_importers(graph).join(graph.nodes.select(F.col("id").alias("importer"), F.col("file").alias("dst")), "importer").select(F.col("file").alias("src"), "dst").distinct()
    seeds = graph.nodes.filter((F.col("kind") == "File") & F.col("id").isin(*files)).select(F.lit(0).alias("seed"), "id")
    found = reach(materialize(steps), seeds).filter("depth > 0").select(F.col("id").alias("file"))
    return found.filter(is_test_file(F.col("file"))) if tests_only else found


def _strong_components(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Vertex -> a name of its strongly connected component, by two depth-first passes."""
    forward, backward = {}, {}
    for a, b in pairs:
        forward.setdefault(a, []).append(b)
        backward.setdefault(b, []).append(a)
    finished, seen = [], set()
    for root in sorted({x for p in pairs for x in p}):
        walk = [] if root in seen else [(root, iter(forward.get(root, ())))]
        seen.add(root)
        while walk:
            following = next((y for y in walk[-1][1] if y not in seen), None)
            if following is None:
                finished.append(walk.pop()[0])
            else:
                seen.add(following)
                walk.append((following, iter(forward.get(following, ()))))
    component: dict[str, str] = {}
    for root in reversed(finished):
        walk = [] if root in component else [root]
        while walk:
            x = walk.pop()
            if x not in component:
                component[x] = root
                walk += backward.get(x, ())
    return component


def _cycles_in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        pairs = [p for b in batches for p in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True)]
        found = _strong_components(pairs)
        groups: dict[str, list[str]] = {}
        for x, name in found.items():
            groups.setdefault(name, []).append(x)
        rows = [(min(g), x) for g in groups.values() if len(g) > 1 for x in g]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["component", "member"])

    return edges.coalesce(1).mapInArrow(run, "component string, member string")


def cycles(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """(component, member) of strongly connected components of two or more members, named by their least member.

    A graph of at most ``few`` edges (counted) is one bounded task with the same answer; a larger one is coloured:

    Forward-backward colouring: the greatest label that reaches a vertex colours it; the vertices of a colour that reach its
    root are the root's component. They leave, and the rest is coloured again. Vertices without an edge in or out leave first.
    """
    open_ = materialize(edges.select("src", "dst").filter("src <> dst").distinct())
    if open_.count() <= few:
        return _cycles_in_one_task(open_)
    found: list[DataFrame] = []
    while True:
        while True:  # trim what can be in no cycle
            before = open_.count()
            open_ = materialize(open_.join(open_.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(open_.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if open_.count() == before:
                break
        if before == 0:
            break
        color = materialize(open_.select(F.col("src").alias("id")).distinct().withColumn("color", F.col("id")))
        while True:
            pushed = open_.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("pushed"))
            after = materialize(color.join(pushed, "id", "left").select("id", F.greatest("color", "pushed").alias("color"), (F.col("pushed") > F.col("color")).alias("moved")))
            moved = not after.filter("moved").isEmpty()
            color = after.select("id", "color")
            if not moved:
                break
        # backwards from the roots, inside their colour
        inner = open_.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        seeds = color.filter("id = color").select(F.col("color").alias("seed"), "id")
        part = materialize(reach(materialize(inner), seeds).select(F.col("seed").alias("root"), F.col("id").alias("member")))
        found.append(part)
        open_ = materialize(open_.join(part.select(F.col("member").alias("src")), "src", "left_anti").join(part.select(F.col("member").alias("dst")), "dst", "left_anti"))
    if not found:
        return open_.select(F.col("src").alias("component"), F.col("dst").alias("member")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    named = out.groupBy("root").agg(F.min("member").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return out.join(named, "root").select("component", "member")


def circular_imports(graph: Graph) -> DataFrame:
    return cycles(file_imports(graph).select(F.col("file").alias("src"), F.col("imported").alias("dst")))


def explore(graph: Graph, question: str, top: int = 15, scan: int = 200, blast: int = 40) -> DataFrame:
    """(section, symbol, id, file, position, total): what a question is about, in one table.

    ``match``: the best ``top`` symbols, by rank, of ``total`` found; ``callers`` and ``callees`` of each match (``symbol``); ``impact``: what
    a change of any match can reach, the first ``blast`` by relevance, of ``total``. A match is left out of its own radius only. Without
    terms in the question the raw search decides, so that filters alone work.
    """
    terms = terms_of(question)
    if terms:
        order = [F.desc("hits"), F.col("best"), F.col("id")]
        ranked = search_terms(graph, terms, scan).join(graph.nodes, "id")
    else:
        order = [F.desc("score"), F.col("qualified_name"), F.col("id")]
        ranked = search_symbols(graph, question, scan)
    ranked = materialize(ranked.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("id", "seq", "file", "position"))
    total = F.lit(ranked.count()).cast("long")  # at most ``scan`` a term
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    hits = ranked.filter(F.col("position") <= top)
    out = hits.select(F.lit("match").alias("section"), text.alias("symbol"), "id", "file", F.col("position").cast("int").alias("position"), total.alias("total"))
    few = hits.select(F.col("id").alias("symbol"))
    for name in ("callers", "callees"):
        direction, kinds = RELATIONS[name]
        near, far = ("to_id", "from_id") if direction == "in" else ("from_id", "to_id")
        e = narrowed(graph.adjacent(direction).filter(F.col("kind").isin(*kinds)), near, few, "symbol")
        hops = e.select(F.col(near).alias("symbol"), F.col(far).alias("id")).join(few, "symbol").distinct().join(graph.nodes.select("id", "file"), "id")
        out = out.unionByName(hops.select(F.lit(name).alias("section"), "symbol", "id", "file", F.lit(None).cast("int").alias("position"), none.alias("total")))
    steps = graph.edges.filter(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).distinct()
    steps = steps.join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    radius = reach(materialize(steps), few.select(F.col("symbol").alias("seed"), F.col("symbol").alias("id"))).filter("depth > 0 and seed <> id").select("id").distinct()
    reached = materialize(radius.join(graph.nodes, "id").select("id", "file", "qualified_name", plain_score().alias("score")))
    first = reached.orderBy(F.desc("score"), "qualified_name", "id").limit(blast)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "qualified_name", "id"))
    return out.unionByName(first.select(F.lit("impact").alias("section"), text.alias("symbol"), "id", "file", place.alias("position"), F.lit(reached.count()).cast("long").alias("total")))


__all__ = ["affected_files", "circular_imports", "cycles", "explore", "impact", "reach", "resolve"]
