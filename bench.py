"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gaugeline.plans import catalog
from gaugeline.session import build_session

HEADLINE = [
    "history_features", "row_lag_features", "rolling_day_windows", "stage1_feature_table", "join_prior_year", "dataset_profile",
    "rank_correlation_matrix", "regression_metrics", "metrics_by_group", "metrics_by_cohort_sets", "cluster_bootstrap", "fusion_fit_transform",
    "conformal_intervals", "interval_metrics", "mahalanobis_distance", "nearest_neighbor_km", "raster_sample_at_points", "orientation_diagnostic",
    "attribution_global", "entity_history_arrays", "asof_nearest_year", "split_repeated", "leakage_gates", "decision_tiers", "train_predict",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", app="gaugeline-bench", shuffle_partitions=int(cpus), spark__driver__memory="16g")
    spark.read.parquet(f"{folder}/orders.parquet").count()          # start the executors before timing
    names = sys.argv[1:] or HEADLINE
    out = {}
    for n in names:
        t0 = time.time()
        catalog.QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
        out[n] = round(time.time() - t0, 3)
        print(f"{n} {out[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
