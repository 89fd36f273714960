"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS.
Each query runs once to warm up, then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "validation_report", "detect_task", "duplicate_rows", "feature_roles", "freq_encode", "preprocess_wide",
    "split_stratified", "cv_folds", "corr_matrix", "histogram_30", "iqr_outliers", "mutual_information",
    "target_statistics", "metric_auc", "class_report", "metric_regression", "reg_linear", "reg_ridge",
    "clf_naive_bayes", "score_batch", "knn_join",
]
# Timed too, but not part of the total, which stays comparable.
FURTHER = ["corr_matrix_wide", "clf_logistic", "clf_random_forest", "tune_ridge", "run_full_reg"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from tabspark.session import local_session
    from tabspark.suite import QUERIES
    spark = local_session("tabspark-bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = os.environ.get("BENCH_QUERIES", "").split() or [*HEADLINE, *FURTHER]
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - started)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(s for n, s in seconds.items() if n not in FURTHER), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
