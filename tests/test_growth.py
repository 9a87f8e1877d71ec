"""Results that must not grow with a group's size, or its square."""

import json

import numpy as np
import pytest

from loomgraph.graph import Graph
from loomgraph.operators import aggregates, derive, scopes


def collected(df):
    """The rows, and the most rows that any join of the plan made."""
    rows = df.collect()
    most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


@pytest.fixture(scope="module")
def hub(spark):
    """One file of 250 functions, each calling two others, beside a small file."""
    nodes = [(i, f"a#{i}", "Function", f"f{i}", "a", i, i + 1) for i in range(250)] + [(900, "a", "File", "a", "a", None, None), (901, "b#0", "Function", "g", "b", None, None)]
    edges = [(1000 + 2 * i + k, f"a#{i}", f"a#{(i + k + 1) % 260}", "Calls") for i in range(250) for k in (0, 1)] + [(2000, "b#0", "a#0", "Calls"), (2001, "b#0", "a#1", "Defines")]
    return Graph(spark.createDataFrame(nodes, "seq long, id string, kind string, name string, file string, start_line int, end_line int"), spark.createDataFrame(edges, "seq long, from_id string, to_id string, kind string"))


def test_export_comes_in_bounded_pieces(hub):
    whole = {r["path"]: json.loads(r["document"]) for r in aggregates.export_documents(hub).collect()}
    pieces = aggregates.export_pieces(hub, 40).orderBy("path", "piece").collect()
    assert len(pieces) >= 20
    for path, document in whole.items():
        mine = [json.loads(r["document"]) for r in pieces if r["path"] == path]
        assert all(p["path"] == path and 0 < len(p["occurrences"]) <= 40 for p in mine)
        for part in ("symbols", "occurrences"):
            assert [x for p in mine for x in p.get(part, [])] == document[part]


def test_nearest_config_of_folders_listed_often(spark):
    files = spark.range(400).selectExpr("concat('src/d', id % 4, '/f', id, '.java') AS file")
    configs = spark.range(400).selectExpr("concat('src/', if(id % 2 = 0, 'd0/', ''), if(id % 3 = 0, 'pom.xml', 'go.mod')) AS path")
    rows, most = collected(scopes.nearest_config(files, configs))
    assert {(int(r["file"][5]), r["config"]) for r in rows} == {(0, "src/d0/go.mod"), (1, "src/go.mod"), (2, "src/go.mod"), (3, "src/go.mod")} and len(rows) == 400
    assert most <= 800


def test_routes_of_one_length_are_not_paired_with_every_request(spark):
    verbs = ("GET", "ANY", "POST")
    names = [f"{verbs[i % 3]} /{'ab'[i % 2]}/{(':id', '*', f'n{i % 50}')[i % 7 % 3]}/{(f'm{i % 11}', ':x')[i % 5 == 0]}" for i in range(600)]
    paths = [f"{verbs[i % 3 % 2 * 2]} /{'abc'[i % 3]}/n{i % 60}/m{i % 13}" for i in range(600)]
    nodes = spark.createDataFrame([(1000 - i, f"r{i}", "Route", n) for i, n in enumerate(names)], "seq long, id string, kind string, name string")
    edges = spark.createDataFrame([(i, f"q{i}", f"route:{p}", "References", None) for i, p in enumerate(paths)], "seq long, from_id string, to_id string, kind string, provenance string")

    def fits(route, asked):
        (verb, pattern), (asked_verb, path) = route.split(" "), asked.split(" ")
        return verb in (asked_verb, "ANY") and len(pattern.split("/")) == len(path.split("/")) and all(p[:1] == ":" or p == "*" or p == s for p, s in zip(pattern.split("/"), path.split("/")))

    expected = set()
    for i, p in enumerate(paths):
        found = [(n.startswith("ANY"), 1000 - k, f"r{k}") for k, n in enumerate(names) if fits(n, p)]
        if found:
            expected.add((f"q{i}", min(found)[2]))
    rows, most = collected(derive.route_edges(nodes, edges))
    assert {(r["from_id"], r["to_id"]) for r in rows} == expected and len(rows) == len(expected) > 200
    assert most <= 10 * len(paths)


@pytest.mark.parametrize("high", [0, 1 << 55, 1 << 61])
def test_decisions_seen_before(high):
    """Keys that leave room for place and bit, for the place alone, and for neither."""
    word_mixer = pytest.importorskip("loomgraph.llm.word_mixer")
    rng = np.random.default_rng(5)
    key, bit = rng.integers(0, 40, 128) + high, rng.integers(0, 2, 128).astype(np.uint8)
    expected = {(i, *(int(((key[:i] == key[i]) & (bit[:i] == b)).sum()) for b in (0, 1))) for i in range(128) if (key[:i] == key[i]).any()}
    assert set(zip(*(x.tolist() for x in word_mixer.seen_before(key, bit)))) == expected
    order, ranked = word_mixer._sorted(key, 8)
    assert order.tolist() == np.argsort(key, kind="stable").tolist() and ranked.tolist() == key[order].tolist()
