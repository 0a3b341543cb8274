"""Headline queries, timed once each after a warm-up: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES=all`` times every registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid import catalog
from pulsegrid.session import local_session

HEADLINE = [
    "s01_event_decode", "s13_access_log", "a03_resample_sum", "a04_missing_interpolate", "a06_fuse_weighted_mean",
    "a07_top_entities_daily", "a11_request_rates", "a13_histogram_quantile", "j01_align_by_position",
    "t01_trailing_totals", "t09_feature_vectors", "t12_rate_limiter", "w10_second_features",
    "w17_training_features", "m06_scaling_policy", "m07_decision_records", "s19_quality_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()
    names = list(queries) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    queries["a11_request_rates"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM up
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
