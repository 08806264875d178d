"""Registered queries against DuckDB on the smallest tables, and contract checks."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check as oc

FOLDER = f"{oc.DATA}/sf0.001"
# One or two per family; `python tests/oracle_check.py 0.01` runs them all. GAUGELINE_ALL=1 widens this test too.
SAMPLE = ["history_features", "row_lag_features", "stage1_feature_table", "join_prior_year", "scan_csv_preamble", "anti_join_rows", "asof_nearest_year",
          "dataset_profile", "rank_correlation_matrix", "quantile_bin_summary", "regression_metrics", "metrics_by_cohort_sets", "paired_config_delta",
          "cluster_bootstrap", "quality_dimensions_v2", "fuse_blocks", "observability_cohorts", "split_repeated", "degrade_inputs", "leakage_gates",
          "leakage_gates_faults", "conformal_intervals", "cqr_intervals", "mahalanobis_distance", "nearest_neighbor_km", "orientation_diagnostic",
          "attribution_global", "positional_prototypes", "local_explanations", "scenario_inputs", "decision_tiers", "well_forecast_view",
          "stream_ingest_readings", "stream_daily_rollup", "history_incremental", "attribution_path_table", "repeated_linear_closed_form", "history_corrections",
          "scan_csv_quarantine", "scan_csv_quarantine_report", "join_prior_year_by_station", "kmeans_restarts"]


@pytest.fixture(scope="module")
def con():
    return oc.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("GAUGELINE_ALL") else SAMPLE)
def test_equals_duckdb(spark, con, name):
    assert oc.compare(con, entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name]) is None


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150
    df = entry.entry(spark)
    assert df.count() > 0 and "prev_value" in df.columns


@pytest.mark.parametrize("name", ["train_predict", "quantile_regressor", "spatial_clusters", "scenario_scoring"])
def test_model_queries_have_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
