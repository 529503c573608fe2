"""Time the headline queries: python bench.py prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tastegraph.demo.registry import queries

HEADLINE = (
    "edge_bidirectional", "node_degree", "title_view", "user_title", "user_taste_affinity", "metric_share", "rank_both_ends",
    "find_paths", "search_titles", "resolve_titles", "sliding_limit", "status_transitions", "suggestion_seeds",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tastegraph-bench").config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registered, times = queries(), {}
    for name in HEADLINE:
        start = time.time()
        try:
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 2)
        except Exception as error:  # noqa: BLE001
            times[name] = None
            print(f"{name}: {error}", file=os.sys.stderr)
    total = round(sum(v for v in times.values() if v is not None), 2)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
