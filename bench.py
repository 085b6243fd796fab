"""Benchmark: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default HEADLINE).
Each query is fully materialised with the ``noop`` sink (all columns,
no collect). The session is warmed first (one small query and one small
pandas stage, so Python worker start-up is not charged to the first query).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans.queries import REGISTRY  # noqa: E402
from faultline.session import cleanup, local_session  # noqa: E402

HEADLINE = [
    "cluster_stats", "risk_metrics", "external_metrics", "load_clean", "merge_left", "combine_inner",
    "standardize", "zscore_outliers", "feature_relevance", "rank_stats", "stratified_folds", "roc_auc",
    "cv_summary", "k_distance", "eps_knee", "eps_neighbours", "dbscan", "silhouette", "davies_bouldin",
    "kmeans", "logreg_cv", "forest_cv", "cluster_experiment", "kdist_curve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    REGISTRY["label_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up: JVM side
    # warm-up: start the Python workers (pandas / Arrow imports) before timing
    spark.range(0, 4096, 1, 64).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        cleanup(spark)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
