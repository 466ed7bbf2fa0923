"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from tabscope.catalog import spark_queries
from tabscope.session import local_session

HEADLINES = [
    "d16_driver_sum",
    "d16_driver_many_segments",
    "d14_compare_metrics",
    "d15_compare_categories",
    "d20_report_metrics",
    "e1_welch",
    "e2_chi_square",
    "d1_summary",
    "d2_value_counts_many",
    "d6_strongest_correlations",
    "d7_outlier_columns",
    "d9_duplicate_rows_wide",
    "d11_insights",
    "j3_detect_outliers",
    "j7_detect_type_issues",
    "j9_detect_all_issues",
    "j11a_fill_median",
    "k1_pii_columns",
    "c1_join_inner",
    "c1_join_outer",
    "c3_join_stats",
    "l1_retention_day",
    "l1_retention_month",
    "m2_m4_m7_trend_summary",
    "m5_m6_forecast",
    "q1_histogram",
    "o1_segments",
    "n3_importance_classification",
]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINES
    queries = spark_queries()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Start the JVM's readers and the Python workers outside the measurement.
    queries["e1_welch"](spark, folder).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # Every result column is computed; nothing is sent to Python.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
