"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the cores. Every query runs twice in one session; ``queries``
holds the second (warm) times, ``cold`` the first. Results are consumed in full
through the noop sink. ``search_qps`` is queries answered per second, warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "to_unified", "clean_run", "remove_duplicates", "price_cap", "enrich_descriptions", "encode",
    "dataset_stats", "hierarchy_build", "lemmatize_join", "knn_flat",
    "search_hierarchical", "search_flat", "search_enhanced", "search_expanded", "search", "ensemble",
    "run_benchmarks",
]
SEARCHES = [n for n in HEADLINE if n.startswith("search")] + ["ensemble"]


def main() -> None:
    from checks import fixtures
    from checks.registry import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("aisle-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        started = time.perf_counter()
        run()
        return round(time.perf_counter() - started, 3)

    def consume(name: str):
        return lambda: REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()

    build = timed(lambda: fixtures.search_index(spark, sf_dir))
    cold, warm = {}, {}
    for name in names:
        cold[name] = timed(consume(name))
        warm[name] = timed(consume(name))
    asked = fixtures.queries(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": sf_dir.rsplit("sf", 1)[-1], "cold": cold, "index_build_cold_sec": build,
        "search_queries": asked,
        "search_qps": {n: round(asked / warm[n], 1) for n in SEARCHES if n in warm},
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
