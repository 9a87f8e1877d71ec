"""A code-graph view of the star-schema tables: containment, calls, types, hierarchy and imports as nodes and edges.

The definition is one portable SQL text; ``{customer}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from . import durable, store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

NODES_SQL = """
SELECT CAST(1 * 1000000000000 + n_nationkey AS BIGINT) AS seq, concat('nation/', n_nationkey) AS id, 'File' AS kind, n_name AS name, concat('nation/', n_nationkey) AS file, '' AS qualified_name, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, 'deep' AS tier FROM {nation}
UNION ALL SELECT min(2 * 1000000000000 + p_partkey), concat('brand/', p_brand), 'File', p_brand, concat('brand/', p_brand), '', CAST(NULL AS INT), CAST(NULL AS INT), 'baseline' FROM {part} GROUP BY p_brand
UNION ALL SELECT 3 * 1000000000000 + r_regionkey, concat('world#', r_name), 'Module', r_name, 'world', r_name, 1 + r_regionkey, 1 + r_regionkey, 'deep' FROM {region}
UNION ALL SELECT 4 * 1000000000000 + c_custkey, concat('nation/', c_nationkey, '#C', c_custkey), 'Class', concat('C', c_custkey), concat('nation/', c_nationkey), concat('C', c_custkey), CAST(c_custkey AS INT), CAST(c_custkey + 9 AS INT), 'deep' FROM {customer}
UNION ALL SELECT 5 * 1000000000000 + s_suppkey, concat('nation/', s_nationkey, '#S', s_suppkey), 'Interface', concat('S', s_suppkey), concat('nation/', s_nationkey), concat('S', s_suppkey), CAST(s_suppkey AS INT), CAST(s_suppkey + 4 AS INT), 'deep' FROM {supplier}
UNION ALL SELECT 6 * 1000000000000 + o_orderkey, concat('nation/', c_nationkey, '#C', o_custkey, '.O', o_orderkey), 'Method', o_orderpriority, concat('nation/', c_nationkey), concat('C', o_custkey, '.O', o_orderkey), CAST(o_orderkey % 100000 AS INT), CAST(o_orderkey % 100000 + 3 AS INT), 'deep' FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 7 * 1000000000000 + p_partkey, concat('brand/', p_brand, '#P', p_partkey), 'Function', p_name, concat('brand/', p_brand), concat('P', p_partkey), CAST(p_partkey % 100000 AS INT), CAST(p_partkey % 100000 + p_size AS INT), 'baseline' FROM {part}
"""

EDGES_SQL = """
SELECT CAST(1 * 100000000000000 + c_custkey AS BIGINT) AS seq, concat('nation/', c_nationkey) AS from_id, concat('nation/', c_nationkey, '#C', c_custkey) AS to_id, 'Defines' AS kind, CAST(NULL AS VARCHAR(9)) AS provenance, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS INT) AS line FROM {customer}
UNION ALL SELECT 2 * 100000000000000 + s_suppkey, concat('nation/', s_nationkey), concat('nation/', s_nationkey, '#S', s_suppkey), 'Defines', NULL, NULL, NULL FROM {supplier}
UNION ALL SELECT 3 * 100000000000000 + o_orderkey, concat('nation/', c_nationkey, '#C', o_custkey), concat('nation/', c_nationkey, '#C', o_custkey, '.O', o_orderkey), 'Defines', NULL, NULL, NULL FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 4 * 100000000000000 + p_partkey, concat('brand/', p_brand), concat('brand/', p_brand, '#P', p_partkey), 'Defines', NULL, NULL, NULL FROM {part}
UNION ALL SELECT 5 * 100000000000000 + l_orderkey * 10 + l_linenumber, concat('nation/', c_nationkey, '#C', o_custkey, '.O', o_orderkey), concat('brand/', p_brand, '#P', p_partkey),
  CASE WHEN l_returnflag = 'N' THEN 'Calls' WHEN l_returnflag = 'A' THEN 'Instantiates' WHEN l_linestatus = 'F' THEN 'Returns' ELSE 'UsesType' END, CASE WHEN l_linestatus = 'O' THEN 'heuristic' END, 1 - l_discount, l_linenumber
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
UNION ALL SELECT 6 * 100000000000000 + min(l_orderkey * 10 + l_linenumber), concat('nation/', c_nationkey, '#C', c_custkey), concat('nation/', s_nationkey, '#S', s_suppkey), 'Implements', NULL, NULL, NULL
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey GROUP BY c_nationkey, c_custkey, s_nationkey, s_suppkey
UNION ALL SELECT 7 * 100000000000000 + a.c_custkey, concat('nation/', a.c_nationkey, '#C', a.c_custkey), concat('nation/', b.c_nationkey, '#C', b.c_custkey), 'Inherits', NULL, NULL, NULL
  FROM {customer} a JOIN {customer} b ON CAST(floor(a.c_custkey / 2) AS BIGINT) = b.c_custkey AND a.c_custkey <> b.c_custkey
UNION ALL SELECT 8 * 100000000000000 + min(l_orderkey * 10 + l_linenumber), concat('nation/', c_nationkey), concat('nation/', s_nationkey), CASE WHEN l_discount >= 0.1 THEN 'Imports' ELSE 'ImportsType' END, NULL, NULL, NULL
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND c_nationkey <> s_nationkey AND (l_discount >= 0.1 OR l_discount < 0.01) GROUP BY c_nationkey, s_nationkey, CASE WHEN l_discount >= 0.1 THEN 'Imports' ELSE 'ImportsType' END
UNION ALL SELECT 9 * 100000000000000 + min(l_orderkey * 10 + l_linenumber), concat('nation/', s_nationkey, '#S', s_suppkey), concat('brand/', p_brand, '#P', p_partkey), 'References', 'call-ref', NULL, NULL
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey GROUP BY s_nationkey, s_suppkey, p_brand, p_partkey
"""


def star_view(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as a view: every use computes it from the tables."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    nodes = spark.sql(NODES_SQL, **{t: v for t, v in tables.items() if "{" + t + "}" in NODES_SQL}).withColumn("external", F.lit(False))
    edges = spark.sql(EDGES_SQL, **{t: v for t, v in tables.items() if "{" + t + "}" in EDGES_SQL})
    return Graph(nodes, edges)


_stored: dict[tuple[str, str], str] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as stored tables, written once a session and folder: see :mod:`loomgraph.plans.store`."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored or not store.complete(spark, _stored[key]):
        view = star_view(spark, sf_dir)
        path = durable.reserve(spark)
        store.write(Graph(durable.materialize(view.nodes), durable.materialize(view.edges)), path)
        _stored[key] = path
    return store.read(spark, _stored[key])


def star_ctes() -> str:
    """The same view as CTEs ``n`` and ``e`` for an oracle."""
    names = {t: t for t in TABLES}
    return f"n AS ({NODES_SQL.format(**names)}), e AS ({EDGES_SQL.format(**names)})"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: one File of lines each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("seq"), F.split("text", "\n").alias("lines"))
