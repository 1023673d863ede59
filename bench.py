"""Headline timings: one warm-up, then the median of three runs per query (some queries once); prints one JSON line.

Environment: BENCH_SF_DIR (folder of tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillwright.catalog import ENTRIES  # noqa: E402
from tillwright.plans.staging import drop_staged  # noqa: E402
from tillwright.session import build_session  # noqa: E402

HEADLINES = [
    "load_audit",
    "load_clean",
    "clean_transactions",
    "cleaning_report",
    "dataset_summary",
    "customer_metrics",
    "top_products_by_revenue",
    "daily_metrics",
    "monthly_metrics",
    "monthly_customer_mix",
    "country_profile",
    "segment_summary",
    "describe_numbers",
    "detect",
    "compare_anomaly_period",
    "multivariate_anomalies",
    "product_contribution",
    "rank_root_causes",
    "investigate",
    "feature_rows",
    "shock_detection_metrics",
    "scenario_eval",
    "cardinality_from_rollup",
    "daily_metrics_from_rollup",
    "report_values",
]
# Timed once, with nothing kept from before: the load of the clean set, and the forecast flow (fit and forecast).
ONCE = ["write_clean", "forecast"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("tillwright-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g")

    def run(name: str) -> float:
        started = time.perf_counter()
        ENTRIES[name].query(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings = {}
    for name in ONCE:
        drop_staged(spark)
        timings[name] = round(run(name), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    for name in HEADLINES:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": folder.rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs, "spark": spark.version,
    }))
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
