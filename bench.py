"""Headline queries: one warm-up, then the median of the timed runs; and the first of all with what it writes. Prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads, BENCH_RUNS the
timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "report_daily", "report_daily_recomputed", "report_from_stored_flag", "dedup_first_wins", "dedup_merged", "dedup_flag_full", "report_project", "breakdown_dimensions",
    "windows_rolling_costs", "rollup_build", "rollup_served_report", "span_window_spend", "quota_instance_measures", "asof_account",
    "join_project_rules", "agg_cost_nok", "anti_remainder", "forecast_daily_rate", "plan_value_by_month",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", 3))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from tallyframe import catalog, registry

    assert catalog
    took = {}
    for name in HEADLINE:
        times = []
        for k in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - start)
            elif name == HEADLINE[0]:  # a fresh session: it starts up, and writes the stored tables that later queries read
                first = round(time.perf_counter() - start, 3)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first_use_sec": first, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
