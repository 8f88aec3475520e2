"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The two catalogs' membership
indexes are timed first, on their own; queries then run on the built index.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from kinweave import registry  # noqa: E402

HEADLINE = [
    "dataset_degrees", "relationship_profile", "relationship_profile_hubs", "entity_counts", "entity_histogram",
    "fan_out", "edge_page", "neighbourhood", "shortest_paths", "entity_paths", "connecting_trees",
    "integrity_findings", "term_frequencies", "lexical_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    logging.disable(logging.CRITICAL)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("kinweave-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before timing

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        times[name] = round(time.time() - start, 2)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("index_orders", lambda: registry._catalog("order", spark, folder).nodes.count())
    timed("index_events", lambda: registry._catalog("event", spark, folder).nodes.count())
    for name in names:
        query = registry.queries()[name]
        timed(name, lambda: query(spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
