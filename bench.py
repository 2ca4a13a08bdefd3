"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The whole chain runs once untimed on the smallest data set beside it, if there is one, so that
the first timed query does not carry JVM start-up and class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time

from millwatch.plans.queries import all_queries
from millwatch.session import clear_scratch, local_session

HEADLINE = (
    "monitor_alarms",
    "asof_snapshot",
    "sliding_windows",
    "forecast_fit",
    "anomaly_score",
    "debounce",
    "control_intervals",
    "parse_records",
    "tolerance_judge",
    "ml_feature_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        registered["monitor_alarms"](spark, smallest).count()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        result = registered[name](spark, sf_dir)
        # A count over a full aggregate of every column keeps Spark from pruning the work away.
        columns = ", ".join(f"`{c}`" for c in result.columns)
        rows[name] = result.selectExpr(f"xxhash64({columns}) AS h").selectExpr("count(h) AS n").first()["n"]
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]} s, {rows[name]} rows", file=sys.stderr)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rows": rows,
        "ticks_scored_per_sec": round(rows["monitor_alarms"] / seconds["monitor_alarms"], 1),
        "windows_fitted_per_sec": round(rows["sliding_windows"] / 5 / seconds["forecast_fit"], 1),
    }
    clear_scratch(spark)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
