"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomgraph import catalog
from loomgraph.plans import lens

HEADLINE = (
    "j01_find_callers",
    "j02_find_callees",
    "j10_find_importers",
    "t01_search_symbol",
    "t05_search_code",
    "a01_schema_census",
    "a10_dedup_edges",
    "g01_impact",
    "g03_circular_imports",
    "d01_dispatch",
    "st02_debounce",
)


def session(cpus: str) -> SparkSession:
    conf = {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    queries["st02_debounce"](spark, sf_dir).count()  # the JVM's start is not a query's time
    timed("index_graph", lambda: lens.star_graph(spark, sf_dir))  # the tables that the questions after it read
    for name in HEADLINE:
        timed(name, lambda name=name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
