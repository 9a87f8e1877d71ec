"""Operators on hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import aggregates, derive, maintain, relations, search, traversal
from loomgraph.sources import ignore
from loomgraph.sources.extract import extract, extract_files

N = "seq long, id string, kind string, name string, file string, qualified_name string, start_line int, end_line int, tier string"
E = "seq long, from_id string, to_id string, kind string, provenance string, confidence double, line int"


def graph(spark, nodes, edges):
    rows = [(i, n[0], n[1], n[2], n[3], n[4] if len(n) > 4 else n[2], None, None, "baseline") for i, n in enumerate(nodes)]
    links = [(i, e[0], e[1], e[2], e[3] if len(e) > 3 else None, e[4] if len(e) > 4 else None, None) for i, e in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, N), spark.createDataFrame(links, E))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_resolution_tiers(spark):
    g = graph(spark, [("a#load", "Method", "load", "a", "Factory.load"), ("a#load1", "Method", "x", "a", "Factory.load(File)"), ("b#y", "Method", "Factory", "b", "y")], [])
    assert ids(relations.resolve(g, "Factory.load")) == ["a#load", "a#load1"]
    assert ids(relations.resolve(g, "b#y")) == ["b#y"]
    assert ids(relations.resolve(g, "nothing")) == []


def test_first_edge_wins(spark):
    g = graph(spark, [("f", "Function", "f", "a"), ("c", "Function", "c", "a")], [("c", "f", "Instantiates"), ("c", "f", "Calls"), ("gone", "f", "Calls")])
    found = relations.relation(g, "f", "callers").collect()
    assert [(r["id"], r["via"]) for r in found] == [("c", "Calls")]


def test_external_supertypes(spark):
    g = graph(spark, [("a#W", "Class", "W", "a"), ("b#R", "Interface", "R", "b")], [("a#W", "type:R", "Implements", "heuristic"), ("a#W", "b#R", "Implements", "type"), ("a#W", "type:X", "Inherits", "heuristic")])
    assert ids(relations.external_supertypes(g, "a#W"), "name") == ["X"]


def test_impact_skips_missing_nodes_and_seeds(spark):
    g = graph(spark, [(x, "Function", x, "f") for x in "abcd"], [("b", "a", "Calls"), ("c", "b", "UsesType"), ("a", "c", "Calls"), ("gone", "a", "Calls"), ("d", "gone", "Calls")])
    found = {r["id"]: r["depth"] for r in traversal.impact(g, relations.resolve(g, "a")).collect()}
    assert found == {"b": 1, "c": 2}
    assert ids(traversal.impact(g, relations.resolve(g, "a"), 1)) == ["b"]


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("b", "c"), ("e", "x"), ("y", "a")], "src string, dst string")
    assert sorted((r["component"], r["member"]) for r in traversal.cycles(edges).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("c", "e")]
    assert sorted(map(tuple, traversal.cycles(edges, few=0).collect())) == sorted(map(tuple, traversal.cycles(edges).collect()))
    assert traversal.cycles(edges.limit(0)).count() == traversal.cycles(edges.limit(0), few=-1).count() == 0


def test_search_parser():
    assert search.parse_query('foo path:src kind:class "two words" x:y kind:enum') == ("foo two words x:y", {"path": "src", "kind": "enum"})
    assert search.parse_query("") == ("", {})


def test_ranking_and_empty_query(spark):
    g = graph(spark, [("1", "Function", "loader", "src/a.ts"), ("2", "Function", "load", "src/a.ts"), ("3", "Function", "load", "tests/a.ts"), ("4", "Function", "preload", "src/a.ts")], [])
    assert [r["id"] for r in search.search_symbols(g, "load").collect()] == ["2", "1", "3", "4"]
    assert search.search_symbols(g, "").count() == 0


def test_comment_run_and_snippet(spark):
    g = graph(spark, [("a#f", "Function", "f", "a")], [])
    nodes = g.nodes.withColumns({"start_line": F.lit(4), "end_line": F.lit(5)})
    sources = spark.createDataFrame([("a", ["x = 1", "// one", "// two", "f() {", "}"])], "path string, lines array<string>")
    g = Graph(nodes, g.edges, sources)
    assert search.bodies(g).first()["body"] == "// one\n// two\nf() {\n}"
    assert search.snippet(g, relations.resolve(g, "f")).first()["snippet"] == "// one\n// two\nf() {\n}"


def test_dedup_keeps_place_and_fills_gaps(spark):
    g = graph(spark, [], [("a", "b", "Calls", "heuristic", 0.5), ("a", "b", "Calls", None, 0.9), ("a", "b", "Calls", "x", 0.9)])
    row = aggregates.dedup_edges(g.edges).collect()
    assert [(r["seq"], r["confidence"], r["provenance"]) for r in row] == [(0, 0.9, "x")]
    again = aggregates.dedup_edges(aggregates.dedup_edges(g.edges)).collect()
    assert [tuple(r[c] for c in sorted(r.asDict())) for r in again] == [tuple(r[c] for c in sorted(r.asDict())) for r in row]


def test_type_and_call_resolution(spark):
    g = graph(spark, [("m.py", "File", "m.py", "m.py", ""), ("m.py#go", "Function", "go", "m.py"), ("h.py", "File", "h.py", "h.py", ""), ("h.py#help", "Function", "help", "h.py"), ("z.py#help", "Function", "help", "z.py"), ("p/A.java#A", "Class", "A", "p/A.java"), ("p/B.java#B", "Class", "B", "p/B.java")], [("m.py", "h.py", "Imports"), ("m.py#go", "call:help", "References", "call-ref"), ("m.py#go", "call:none", "References", "call-ref"), ("p/A.java#A", "type:B", "Inherits", "heuristic")])
    assert [(r["from_id"], r["to_id"], r["kind"]) for r in derive.call_edges(g.nodes, g.edges).collect()] == [("m.py#go", "h.py#help", "Calls")]
    assert [(r["from_id"], r["to_id"], r["kind"]) for r in derive.type_edges(g.nodes, g.edges).collect()] == [("p/A.java#A", "p/B.java#B", "Inherits")]


def test_dispatch(spark):
    g = graph(spark, [("I", "Interface", "I", "a"), ("I.m", "Method", "m", "a"), ("C", "Class", "C", "a"), ("C.m", "Method", "m", "a"), ("f", "Function", "f", "a")], [("I", "I.m", "Defines"), ("C", "C.m", "Defines"), ("C", "I", "Implements"), ("f", "I.m", "Calls")])
    assert sorted((r["from_id"], r["to_id"], r["kind"]) for r in derive.dispatch_edges(g.nodes, g.edges).collect()) == [("C.m", "I.m", "Overrides"), ("f", "C.m", "Calls")]
    once = derive.derive_all(g.nodes, g.edges)
    assert sorted((r["from_id"], r["to_id"], r["kind"]) for r in once.collect()) == sorted((r["from_id"], r["to_id"], r["kind"]) for r in derive.derive_all(g.nodes, once).collect())


def test_env_prisma_and_routes(spark):
    g = graph(spark, [(".env#KEY", "Variable", "KEY", ".env"), ("s.prisma#User", "Class", "User", "s.prisma"), ("s.prisma#User.id", "Property", "id", "s.prisma", "User.id"), ("r1", "Route", "ANY /users/:id", "r"), ("r2", "Route", "GET /users/:id", "r"), ("f", "Function", "f", "x")], [("f", "env:KEY", "References", "env-ref"), ("f", "env:NO", "References", "env-ref"), ("f", "prisma:model:user", "References", "prisma-ref"), ("f", "prisma:field:user.id", "References", "prisma-ref"), ("f", "route:GET /users/1/", "References", "call-ref"), ("f", "route:GET /nope/1", "References", "call-ref")])
    assert ids(derive.env_edges(g.nodes, g.edges), "to_id") == [".env#KEY"]
    assert ids(derive.prisma_edges(g.nodes, g.edges), "to_id") == ["s.prisma#User", "s.prisma#User.id"]
    assert ids(derive.route_edges(g.nodes, g.edges), "to_id") == ["r2"]


def test_reconcile_equals_rebuild(spark):
    g = graph(spark, [("a#x", "Function", "x", "a"), ("b#y", "Function", "y", "b")], [("a#x", "b#y", "Calls"), ("b#y", "a#x", "Calls")])
    new = graph(spark, [("a#z", "Function", "z", "a")], [("a#z", "b#y", "Calls")])
    paths = spark.createDataFrame([("a",)], "path string")
    nodes, edges = maintain.reconcile(g.nodes, g.edges, paths, new.nodes, new.edges.withColumn("seq", F.col("seq") + 100))
    assert ids(nodes) == ["a#z", "b#y"]
    assert sorted((r["from_id"], r["to_id"]) for r in edges.collect()) == [("a#z", "b#y"), ("b#y", "a#x")]


def test_ignore_rules(spark):
    rules = ignore.Rules().add("*.log\n/root-only.ts\n!keep.log\nsub/cache/").add("/anchored.ts", "pkg")
    paths = ["a.log", "x/keep.log", "root-only.ts", "sub/root-only.ts", "sub/cache/d.ts", "pkg/anchored.ts", "pkg/sub/anchored.ts", "node_modules/a.js", ".git/x", "src/a.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").filter(~ignore.ignored(F.col("path"), rules))
    assert ids(df, "path") == ["pkg/sub/anchored.ts", "src/a.ts", "sub/root-only.ts", "x/keep.log"]


@pytest.mark.parametrize(
    ("path", "text", "expected"),
    [
        ("a.py", "class A:\n    def m(self):\n        return f()\ndef f():\n    pass\n", {"A", "A.m", "f"}),
        ("A.java", "class A {\n  int v;\n  int m(int x) {\n    return x;\n  }\n}\ninterface I {\n  void g();\n}\n", {"A", "A.m", "I", "I.g"}),
        ("a.ts", "// class No {}\nexport class A {\n  run(): void {\n  }\n}\nconst f = (x) => x;\ntype T = string;\n", {"A", "A.run", "f", "T"}),
        ("m.go", "type S struct {\n}\nfunc (s S) Area() int {\n}\nfunc main() {\n}\n", {"S", "Area", "main"}),
        (".env", "A=1\nexport B=2\n# C=3\n", {"A", "B"}),
    ],
)
def test_extraction(path, text, expected):
    assert {n[2] for n in extract(path, text).nodes if n[2]} == expected


def test_extract_files_isolates_failures_and_binds_imports(spark):
    files = spark.createDataFrame([("p/a.py", b"from .b import f\ndef g():\n    f()\n"), ("p/b.py", b"def f():\n    pass\n"), ("p/bad.py", b"def (\n")], "path string, content binary")
    nodes, edges, errors = extract_files(files)
    assert ids(errors, "file") == ["p/bad.py"]
    assert ("p/a.py", "p/b.py") in {(r["from_id"], r["to_id"]) for r in edges.filter("kind = 'Imports'").collect()}
    assert ("p/a.py#g", "p/b.py#f") in {(r["from_id"], r["to_id"]) for r in derive.call_edges(nodes, edges).collect()}


def test_change_feed(spark, tmp_path):
    from loomgraph.streaming import changes

    rows = [("p", "2024-01-01 00:00:00", "a"), ("p", "2024-01-01 00:00:01", "a"), ("p", "2024-01-01 00:00:01", "b"), ("p", "2024-01-01 00:05:00", "c")]
    events = spark.createDataFrame(rows, "project string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(tuple(r["paths"]) for r in changes.debounce(events, "10 seconds").collect()) == [("a", "b"), ("c",)]
    events.write.parquet(str(tmp_path / "feed"))
    seen = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "feed"))
    changes.run_updates(stream, lambda paths, n: seen.extend(ids(paths, "path")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"]
    banner = changes.staleness_banner(events.select("path").distinct(), 2).first()
    assert (banner["n"], banner["paths"], banner["more"]) == (3, ["a", "b"], 1)
