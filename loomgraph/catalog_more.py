"""Further registered queries of the graph engine: derivations, maintenance, statistics and text, each with its SQL.

Where the lens has no rows of a kind (candidates, languages, fingerprints), they are made from the tables by one SQL text that both
engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_deprioritized, is_test_file
from .graph import Graph
from .operators import aggregates, derive, maintain, relations, scopes, search
from .plans import lens
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_LENS = lens.star_ctes()
EDGE = ["seq", "from_id", "to_id", "kind", "provenance"]
FILE = "nation/3"

TYPE_CANDIDATES = """SELECT CAST(950000000000000 + c_custkey AS BIGINT) AS seq, concat('nation/', c_nationkey, '#C', c_custkey) AS from_id,
 concat('type:S', c_custkey % 20 + 1) AS to_id, 'Implements' AS kind, 'heuristic' AS provenance FROM {customer}"""
CALL_CANDIDATES = """SELECT CAST(960000000000000 + s_suppkey AS BIGINT) AS seq, concat('nation/', s_nationkey, '#S', s_suppkey) AS from_id,
 CASE s_suppkey % 3 WHEN 0 THEN 'call:1-URGENT' WHEN 1 THEN 'call:x.5-LOW' ELSE 'call:none' END AS to_id, 'References' AS kind, 'call-ref' AS provenance FROM {supplier}"""
METHOD_CALLS = """SELECT CAST(970000000000000 + o_orderkey AS BIGINT) AS seq, concat('nation/', s_nationkey, '#S', s_suppkey) AS from_id,
 concat('nation/', c_nationkey, '#C', o_custkey, '.O', o_orderkey) AS to_id, 'Calls' AS kind, CAST(NULL AS VARCHAR(9)) AS provenance
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON s_suppkey = o_orderkey % 10 + 1"""
MODELS = """SELECT CAST(p_partkey AS BIGINT) AS seq, concat('s.prisma#', p_partkey) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Class' ELSE 'Property' END AS kind,
 p_name AS name, 's.prisma' AS file, concat(p_brand, '.', p_name) AS qualified_name FROM {part}"""
MODEL_CANDIDATES = """SELECT CAST(p_partkey AS BIGINT) AS seq, concat('f#', p_partkey % 50) AS from_id,
 CASE WHEN p_partkey % 3 = 0 THEN concat('prisma:model:', upper(p_name)) ELSE concat('prisma:field:', p_brand, '.', p_name) END AS to_id, 'References' AS kind, 'prisma-ref' AS provenance FROM {part}"""
VARIABLES = """SELECT CAST(n_nationkey AS BIGINT) AS seq, concat('v#', n_nationkey) AS id, 'Variable' AS kind, n_name AS name,
 CASE WHEN n_nationkey % 4 = 0 THEN 'app/.env.example' ELSE 'app/.env' END AS file, n_name AS qualified_name FROM {nation}"""
VARIABLE_CANDIDATES = """SELECT CAST(c_custkey AS BIGINT) AS seq, concat('f#', c_custkey % 70) AS from_id, concat('env:', n_name) AS to_id, 'References' AS kind,
 CASE WHEN c_custkey % 5 = 0 THEN 'call-ref' ELSE 'env-ref' END AS provenance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
SYMBOLS = """SELECT CAST(doc_id AS BIGINT) AS seq, concat('src/d', doc_id % 7, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.vue' ELSE '.test.js' END, '#', doc_id) AS id,
 'Function' AS kind, concat('f', doc_id) AS name, concat('src/d', doc_id % 7, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.vue' ELSE '.test.js' END) AS file,
 concat('m.f', doc_id) AS qualified_name, CASE WHEN doc_id % 2 = 0 THEN 'deep' ELSE 'baseline' END AS tier FROM {documents}"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [t for t in (*lens.TABLES, "documents") if "{" + t + "}" in text]
    return spark.sql(text, **{t: _table(spark, sf_dir, t) for t in names})


def _sql(text: str) -> str:
    return text.format(**{t: t for t in (*lens.TABLES, "documents")})


def _extended(spark: SparkSession, sf_dir: str, *texts: str) -> Graph:
    """The lens with further edges."""
    graph = lens.star_graph(spark, sf_dir)
    edges = graph.edges
    for text in texts:
        edges = edges.unionByName(made(spark, sf_dir, text), allowMissingColumns=True)
    return graph.with_edges(edges)


_BY_SCOPE = """i AS (SELECT e.from_id AS file, n.file AS target, e.seq FROM e JOIN n ON n.id = e.to_id WHERE e.kind IN ('Imports', 'ImportsType')),
d AS (SELECT name, file, arg_min(id, seq) AS id, min(seq) AS seq FROM n WHERE kind IN ({kinds}) GROUP BY name, file),
c AS (SELECT c0.seq, from_id, regexp_extract(substr(to_id, 6), '[^.]*$') AS name, c0.kind, n.file FROM c0 JOIN n ON n.id = from_id),
m AS (SELECT c.*, d.id AS target, 0 AS prio, 0 AS import_seq, d.seq AS def_seq FROM c JOIN d USING (name, file)
      UNION ALL SELECT c.*, d.id, 2, i.seq, d.seq FROM c JOIN i ON i.file = c.file JOIN d ON d.name = c.name AND d.file = i.target),
r AS (SELECT *, row_number() OVER (PARTITION BY seq, from_id, name, kind ORDER BY prio, import_seq, def_seq) AS rn FROM m WHERE from_id <> target)
SELECT min(seq) AS seq, from_id, target AS to_id, {kind} AS kind, '{provenance}' AS provenance FROM r WHERE rn = 1 GROUP BY from_id, target{group}"""


def _type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _extended(spark, sf_dir, TYPE_CANDIDATES)
    return derive.type_edges(graph.nodes, graph.edges).select(EDGE)


def _call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _extended(spark, sf_dir, CALL_CANDIDATES)
    return derive.call_edges(graph.nodes, graph.edges).select(EDGE)


def _dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _extended(spark, sf_dir, METHOD_CALLS)
    return derive.dispatch_edges(graph.nodes, graph.edges).select(EDGE)


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _extended(spark, sf_dir, TYPE_CANDIDATES)
    edges = graph.edges.unionByName(derive.type_edges(graph.nodes, graph.edges))
    found = None
    for id in ("nation/3#C3", *(r["id"] for r in graph.nodes.filter("kind = 'Class'").orderBy("seq").limit(3).select("id").collect())):
        one = relations.external_supertypes(graph.with_edges(edges), id).select(F.lit(id).alias("id"), "name")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = made(spark, sf_dir, SYMBOLS)
    files = symbols.select(F.col("file").alias("path")).distinct()
    nodes = symbols.select("seq", F.col("file").alias("id"), F.lit("File").alias("kind"), "tier").groupBy("id", "kind").agg(F.min("seq").alias("seq"), F.min_by("tier", "seq").alias("tier"))
    return aggregates.language_census(Graph(nodes, nodes), files)


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    per = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 2 == 0).alias("even"))
    return per.groupBy("user_id").agg(F.sum("n").alias("calls_total"), F.sum("even").alias("calls_resolved"), F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("unresolved"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.merge_resolution(_statistics(spark, sf_dir)).select("calls_total", "calls_resolved", F.explode("unresolved").alias("name", "n"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.resolution_rate(_statistics(spark, sf_dir)).select("user_id", F.round("rate", 9).alias("rate"))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return aggregates.upsert_nodes(e)


def _overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.overloads(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("descriptor")))


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lens.star_graph(spark, sf_dir)
    paths = spark.createDataFrame([(FILE,)], "path string")
    nodes = graph.nodes.filter((F.col("file") == FILE) & (F.col("kind") != "Method"))
    edges = graph.edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(graph.edges.columns)
    kept, kept_edges = maintain.reconcile(graph.nodes, graph.edges, paths, nodes, edges)
    return kept.select(F.col("id").alias("a"), F.lit("").alias("b"), "kind").unionByName(kept_edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "kind"))


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lens.star_graph(spark, sf_dir)
    new = made(spark, sf_dir, TYPE_CANDIDATES).withColumns({"confidence": F.lit(None).cast("double"), "line": F.lit(None).cast("int")})
    return maintain.replace_provenance(graph.edges, "heuristic", new).select("from_id", "to_id", "kind", "provenance")


def _symbol_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A symbol a document: its text from line 2 to 3, below what may be a comment."""
    docs = _table(spark, sf_dir, "documents")
    sources = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.split("text", "\n").alias("lines"))
    sources = sources.withColumn("lines", F.when(F.regexp_extract("path", r"\d+$", 0).cast("long") % 3 == 0, F.concat(F.array(F.lit("  // about this")), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))).otherwise(F.col("lines")))
    id = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    columns = [F.col("doc_id").alias("seq"), id.alias("id"), F.lit("Function").alias("kind"), id.alias("name"), id.alias("file"), id.alias("qualified_name"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"), F.lit("baseline").alias("tier")]
    nodes = docs.filter("text is not null").select(columns)
    return Graph(nodes, nodes, sources)


_BODIES = r"""l AS (SELECT doc_id, 'doc/' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN list_prepend('  // about this', string_split(text, chr(10))[2:]) ELSE string_split(text, chr(10)) END AS lines FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, id, CASE WHEN regexp_matches(trim(lines[1]), '^(//|/\*|\*|#|--)') THEN 1 ELSE 2 END AS start_line, lines FROM l),
x AS (SELECT doc_id, id, start_line, array_to_string(lines[start_line:3], chr(10)) AS body FROM b)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    name = F.concat(F.element_at(F.array(F.lit("src/"), F.lit("Tests/"), F.lit("a/dist/"), F.lit("x.test.")), (F.col("page_id") % 4 + 1).cast("int")), path)
    return _table(spark, sf_dir, "pages").select("page_id", is_test_file(name).alias("is_test"), is_deprioritized(name).alias("deprioritized"))


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "ts", "event_id")
    flushed = e.filter("event_id % 3 = 0").groupBy("path").agg(F.max("ts").alias("closed")).select(F.array("path").alias("paths"), "closed")
    return e, flushed


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.pending(*_feed(spark, sf_dir))


def _banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = changes.staleness_banner(_pending(spark, sf_dir))
    return row.select("n", F.array_join("paths", ",").alias("paths"), "more")


_PENDING = """e AS (SELECT 'u' || user_id AS path, ts, event_id FROM events), f AS (SELECT path, max(ts) AS closed FROM e WHERE event_id % 3 = 0 GROUP BY path),
w AS (SELECT e.path, max(ts) AS ts FROM e GROUP BY e.path), p AS (SELECT w.path, w.ts FROM w LEFT JOIN f USING (path) WHERE closed IS NULL OR w.ts > closed)"""
_MEMBERS = "mem AS (SELECT from_id AS owner, name, arg_max(id, x.seq) AS method FROM x JOIN n ON n.id = x.to_id AND n.kind = 'Method' WHERE x.kind = 'Defines' GROUP BY ALL)"
_EXT = "regexp_extract(file, '(\\.[^./]*)$', 1)"


FILES = "SELECT concat('src/d', doc_id % 7, CASE WHEN doc_id % 3 = 0 THEN '/in' ELSE '' END, '/f', doc_id, '.java') AS file FROM {documents}"
CONFIGS = "SELECT concat('src', CASE WHEN doc_id % 7 < 3 THEN concat('/d', doc_id % 7) ELSE '' END, CASE WHEN doc_id % 14 = 1 THEN '/in' ELSE '' END, '/go.mod') AS path FROM {documents}"
IMPORTED = "SELECT concat('src/d', doc_id % 7, '/in/f', doc_id, '.java') AS file, concat('in/f', 3 * (doc_id % 20), '.java') AS name FROM {documents}"
NAMES = "SELECT DISTINCT concat('App.', lang, '.', source, '.C', doc_id % 9) AS name FROM {documents}"
PREFIXES = "SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'App' WHEN 1 THEN concat('App.', lang) ELSE concat('App.', lang, '.', source) END AS prefix, concat('lib/', CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang ELSE concat(lang, '-', source) END) AS folder FROM {documents}"


def pairs() -> dict[str, tuple[Query, str | None]]:
    """name -> (query, SQL)."""
    scope = lambda text, kinds, kind, provenance, group: f"WITH {_LENS}, c0 AS ({_sql(text)}), " + _BY_SCOPE.format(kinds=kinds, kind=kind, provenance=provenance, group=group)
    types = scope(TYPE_CANDIDATES, "'Class', 'Interface', 'Enum', 'TypeAlias'", "kind", "type", ", kind")
    projects = "VALUES ('a', '/w'), ('b', '/w/app'), ('c', '/w/application')"
    return {
        "d01_dispatch": (
            _dispatch,
            f"""WITH {_LENS}, x AS (SELECT seq, from_id, to_id, kind FROM e UNION ALL SELECT seq, from_id, to_id, kind FROM ({_sql(METHOD_CALLS)})), {_MEMBERS},
t AS (SELECT from_id AS sub, to_id AS super, seq FROM x WHERE kind IN ('Inherits', 'Implements')),
o AS (SELECT t.seq, a.method AS from_id, b.method AS to_id, 'Overrides' AS kind FROM t JOIN mem a ON a.owner = t.sub JOIN mem b ON b.owner = t.super AND a.name = b.name
 UNION ALL SELECT x.seq, x.from_id, a.method, 'Calls' FROM x JOIN n m ON m.id = x.to_id AND m.kind = 'Method' JOIN x d ON d.to_id = x.to_id AND d.kind = 'Defines'
   JOIN n w ON w.id = d.from_id AND w.kind IN ('Class', 'Interface') JOIN t ON t.super = d.from_id JOIN mem a ON a.owner = t.sub AND a.name = m.name WHERE x.kind = 'Calls')
SELECT min(seq) AS seq, from_id, to_id, kind, 'dispatch' AS provenance FROM o WHERE from_id <> to_id GROUP BY from_id, to_id, kind""",
        ),
        "d02_type_edges": (_type_edges, types),
        "d03_call_edges": (_call_edges, scope(CALL_CANDIDATES, "'Function', 'Method'", "'Calls'", "call", "")),
        "d04_prisma_references": (
            lambda s, d: derive.prisma_edges(made(s, d, MODELS), made(s, d, MODEL_CANDIDATES)).select(EDGE),
            f"""WITH n AS ({_sql(MODELS)}), c AS ({_sql(MODEL_CANDIDATES)}),
k AS (SELECT key, arg_max(id, seq) AS id FROM (SELECT 'prisma:model:' || lower(name) AS key, id, seq FROM n WHERE kind = 'Class' UNION ALL SELECT 'prisma:field:' || lower(qualified_name), id, seq FROM n WHERE kind = 'Property') GROUP BY key)
SELECT min(seq) AS seq, from_id, id AS to_id, 'References' AS kind, 'prisma' AS provenance FROM c JOIN k ON k.key = lower(to_id) GROUP BY from_id, id""",
        ),
        "d06_env_references": (
            lambda s, d: derive.env_edges(made(s, d, VARIABLES), made(s, d, VARIABLE_CANDIDATES)).select(EDGE),
            f"""WITH n AS ({_sql(VARIABLES)}), c AS ({_sql(VARIABLE_CANDIDATES)})
SELECT min(c.seq) AS seq, from_id, id AS to_id, 'References' AS kind, 'env' AS provenance FROM c JOIN n ON to_id = 'env:' || name WHERE provenance = 'env-ref' AND file LIKE '%.env' GROUP BY from_id, id""",
        ),
        "j16_external_supertypes": (
            _external,
            f"""WITH {_LENS}, c AS (SELECT from_id, substr(to_id, 6) AS name FROM ({_sql(TYPE_CANDIDATES)})), d AS ({types.replace("WITH " + _LENS + ",", "WITH", 1)}),
q AS (SELECT 'nation/3#C3' AS id UNION SELECT id FROM (SELECT id FROM n WHERE kind = 'Class' ORDER BY seq LIMIT 3)),
r AS (SELECT from_id, to_id FROM e WHERE kind IN ('Inherits', 'Implements') UNION SELECT from_id, to_id FROM d)
SELECT DISTINCT q.id, c.name FROM q JOIN c ON c.from_id = q.id WHERE NOT EXISTS (SELECT 1 FROM r JOIN n ON n.id = r.to_id WHERE r.from_id = q.id AND n.name = c.name)""",
        ),
        "j23_nearest_ancestor": (
            lambda s, d: scopes.nearest_ancestor(made(s, d, IMPORTED), made(s, d, FILES).withColumnRenamed("file", "path")),
            f"""WITH w AS (SELECT DISTINCT * FROM ({_sql(IMPORTED)})), f AS (SELECT DISTINCT file AS path FROM ({_sql(FILES)})), m AS (SELECT w.file, w.name, f.path,
 length(regexp_replace(f.path, '/?' || replace(w.name, '.', '[.]') || '$', '')) AS depth FROM w JOIN f ON (f.path = w.name OR f.path LIKE '%/' || w.name) AND f.path <> w.file
 AND starts_with(w.file, regexp_replace(f.path, replace(w.name, '.', '[.]') || '$', '')))
SELECT file, name, arg_max(path, depth) AS target FROM m GROUP BY file, name""",
        ),
        "j24_longest_prefix": (
            lambda s, d: scopes.longest_prefix(made(s, d, NAMES), made(s, d, PREFIXES), "."),
            f"""WITH n AS ({_sql(NAMES)}), p AS ({_sql(PREFIXES)}), m AS (SELECT name, prefix, folder, row_number() OVER (PARTITION BY name ORDER BY length(prefix) DESC) AS rn FROM n JOIN p ON starts_with(name, prefix || '.'))
SELECT name, prefix, folder, substr(name, length(prefix) + 2) AS rest FROM m WHERE rn = 1""",
        ),
        "j25_nearest_config": (
            lambda s, d: scopes.nearest_config(made(s, d, FILES), made(s, d, CONFIGS)),
            f"""WITH f AS (SELECT DISTINCT * FROM ({_sql(FILES)})), c AS (SELECT DISTINCT path, regexp_replace(path, 'go[.]mod$', '') AS folder FROM ({_sql(CONFIGS)}))
SELECT file, arg_max(path, length(folder)) AS config FROM f JOIN c ON starts_with(file, folder) GROUP BY file""",
        ),
        "a02_counts": (lambda s, d: aggregates.counts(lens.star_graph(s, d)), f"WITH {_LENS} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges"),
        "a03_languages": (
            _languages,
            f"""WITH y AS ({_sql(SYMBOLS)}), f AS (SELECT file, arg_min(tier, seq) AS tier, min(seq) AS seq FROM y GROUP BY file),
g AS (SELECT *, CASE {_EXT} WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' END AS language FROM f)
SELECT language, count(*) AS files, arg_min(tier, seq) AS tier FROM g WHERE language IS NOT NULL GROUP BY language""",
        ),
        "a05_merged_resolution": (_merged, "SELECT (SELECT count(*) FROM events) AS calls_total, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS calls_resolved, event_type AS name, count(*) AS n FROM events GROUP BY event_type"),
        "a11_upserted_nodes": (_upserted, "SELECT 'u' || user_id AS id, min(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id"),
        "a12_overloads": (_overloads, "SELECT o_custkey AS owner, o_orderpriority AS name, count(DISTINCT o_orderstatus) AS overloads FROM orders GROUP BY ALL"),
        "a13_saved_share": (
            lambda s, d: aggregates.saved_share(_table(s, d, "orders").select(F.lit(1).alias("calls"), F.col("o_custkey").alias("tokens"), F.lit(20).alias("base_calls"), (F.col("o_orderkey") * 10).alias("base_tokens"))),
            "SELECT count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS tokens, 20 * count(*) AS base_calls, CAST(sum(o_orderkey) * 10 AS BIGINT) AS base_tokens, 95.0::DOUBLE AS calls_saved, round((1 - sum(o_custkey) / (sum(o_orderkey) * 10)) * 100, 3) AS tokens_saved FROM orders",
        ),
        "a14_resolution_rate": (_rates, "SELECT user_id, round(count(*) FILTER (event_id % 2 = 0) / count(*), 9) AS rate FROM events GROUP BY user_id"),
        "f10_search_language": (
            lambda s, d: search.search_symbols(Graph(made(s, d, SYMBOLS), made(s, d, SYMBOLS)), "lang:Python f1").select("id", "score"),
            f"""WITH y AS ({_sql(SYMBOLS)}) SELECT id, 8 + CASE WHEN name = 'f1' OR qualified_name = 'f1' THEN 100 WHEN starts_with(name, 'f1') THEN 60 WHEN contains(name, 'f1') THEN 30 ELSE 12 END + greatest(0, 16 - length(name)) AS score
FROM y WHERE contains(qualified_name, 'f1') AND {_EXT} = '.py' ORDER BY score DESC, qualified_name, id LIMIT 50""",
        ),
        "f14_test_and_deprioritized_files": (
            _flags,
            r"""WITH p AS (SELECT page_id, lower(['src/', 'Tests/', 'a/dist/', 'x.test.'][(page_id % 4 + 1)::INT] || regexp_extract(url, '^https?://[^/]+/(.*)$', 1)) AS f FROM pages),
t AS (SELECT *, regexp_matches(f, '(^|/)(tests?|__tests__)/') OR regexp_matches(f, '\.(test|spec)\.') AS is_test FROM p)
SELECT page_id, is_test, is_test OR f LIKE '%.d.ts' OR contains(f, '.generated.') OR regexp_matches(f, '(^|/)(dist|build|coverage)/') AS deprioritized FROM t""",
        ),
        "f16_files_by_glob": (
            lambda s, d: aggregates.listed_files(made(s, d, SYMBOLS).select(F.col("file").alias("path")).distinct(), glob="src/**/*.?s"),
            f"WITH y AS ({_sql(SYMBOLS)}) SELECT DISTINCT file AS path FROM y WHERE regexp_matches(file, '^src/(.*/)?[^/]*\\.[^/]s$')",
        ),
        "f17_files_by_part": (lambda s, d: aggregates.listed_files(made(s, d, SYMBOLS).select(F.col("file").alias("path")).distinct(), part="d3."), f"WITH y AS ({_sql(SYMBOLS)}) SELECT DISTINCT file AS path FROM y WHERE contains(file, 'd3.')"),
        "f19_project_of": (
            lambda s, d: aggregates.project_of(s.createDataFrame([("a", "/w"), ("b", "/w/app"), ("c", "/w/application")], "project string, root string"), "/w/app/x.ts"),
            f"SELECT * FROM ({projects}) v(project, root) WHERE root = '/w/app/x.ts' OR starts_with('/w/app/x.ts', root || '/') ORDER BY length(root) DESC LIMIT 1",
        ),
        "f20_tier_of": (lambda s, d: relations.tier_of(lens.star_graph(s, d), "C12"), f"WITH {_LENS} SELECT id, tier FROM n WHERE name = 'C12' ORDER BY seq LIMIT 1"),
        "m02_reconciled_file": (
            _reconciled,
            f"""WITH {_LENS}, g AS (SELECT id FROM n WHERE file = '{FILE}' AND kind = 'Method')
SELECT id AS a, '' AS b, kind FROM n WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT DISTINCT from_id, to_id, kind FROM e WHERE from_id NOT IN (SELECT id FROM g)""",
        ),
        "m03_replaced_provenance": (
            _replaced,
            f"""WITH {_LENS}, x AS (SELECT from_id, to_id, kind, provenance, confidence, seq FROM e WHERE provenance IS DISTINCT FROM 'heuristic' UNION ALL SELECT from_id, to_id, kind, provenance, NULL, seq FROM ({_sql(TYPE_CANDIDATES)})),
r AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY coalesce(confidence, -1) DESC, seq) AS k FROM x)
SELECT from_id, to_id, kind, first(provenance ORDER BY k) FILTER (provenance IS NOT NULL) AS provenance FROM r GROUP BY from_id, to_id, kind""",
        ),
        "t05_search_symbol_bodies": (
            lambda s, d: search.search_code(search.bodies(_symbol_graph(s, d)), "about this"),
            f"WITH {_BODIES} SELECT doc_id AS seq, id, false AS via_terms, 1 AS hits FROM x WHERE contains(lower(body), 'about this') ORDER BY doc_id LIMIT 50",
        ),
        "t09_snippet": (
            lambda s, d: search.snippet(_symbol_graph(s, d), relations.resolve(_symbol_graph(s, d), "doc/3")),
            f"WITH {_BODIES} SELECT id, id AS file, start_line, 3 AS end_line, body AS snippet FROM x WHERE doc_id = 3",
        ),
        "t10_comment_starts": (
            lambda s, d: search.bodies(_symbol_graph(s, d)).select("id", F.md5("body").alias("body")),
            f"WITH {_BODIES} SELECT id, md5(body) AS body FROM x",
        ),
        "st04_pending": (_pending, f"WITH {_PENDING} SELECT path, ts FROM p"),
        "st05_banner": (_banner, f"WITH {_PENDING} SELECT count(*) AS n, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM p ORDER BY path LIMIT 10)) AS paths, greatest(0, count(*) - 10) AS more FROM p"),
    }
