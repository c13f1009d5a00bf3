"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local cores.  Every query runs once, from reading the tables to counting the result; a
small query before the clock starts brings the session up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from trailweave.plans.queries import QUERIES

HEADLINE = [
    "transition_probabilities",
    "dfg_by_case",
    "dfg_by_order",
    "neighbourhood_pairs",
    "decay_weights",
    "frequent_components",
    "part_components",
    "component_count_sweep",
    "lpa_window",
    "lpa_daily",
    "scc",
    "flow_groups",
    "greedy_merge",
    "threshold_communities",
    "consensus_clusters",
    "overlapping_clusters",
    "walk_clusters",
    "walk_threshold_sweep",
    "score_all",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["dfg_global"](spark, folder).count()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
