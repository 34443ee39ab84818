"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.catalog import QUERIES  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    "volume_features", "window_counts", "gap_fill", "rolling_stats", "template_counts", "rarity_lookup", "first_seen_template",
    "template_drift", "sample_errors", "alarm_lines", "anomaly_summary_hourly", "results_latest", "latency_percentiles",
    "all_features", "tfidf", "eps_neighbors", "dbscan_fit", "anomaly_score", "detect_batch", "tune_grid", "isolation_forest",
    "silhouette", "stream_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
