"""Time the headline queries: one warm-up, then the median of three runs to a noop sink."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortgrid.plans import QUERIES  # noqa: E402
from cohortgrid.session import local_session  # noqa: E402

HEADLINE = [
    "metric_hourly", "hourly_health", "daily_health", "weekly_health_labels", "fill_interpolate",
    "asof_next_survey", "lookback_hour_slots_std", "multiwindow_training", "subwindow_features",
    "subwindow_features_actual", "multiwindow_category", "combined_features", "sweep_features",
    "app_sessions", "gap_repair", "hourly_screentime", "categorize_apps", "category_stats",
    "category_cooccurrence", "risk_labels", "daily_labels_averaged", "status_matrix", "split_by_user",
    "classification_metrics", "roc_auc", "category_insights", "impute_median", "lr_predictions", "rf_predictions",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for attempt in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(root.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
