"""Registered queries next to their SQL on the smallest tables. A sample of every family by default,
all of them with ``ALL_QUERIES=1``."""

import os

import pytest

from check import compare, connect
from pulsegrid import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = """a01_events_per_second a03_resample_sum a04_missing_interpolate a06_fuse_weighted_mean a07_top_entities_daily
a10_surge_baseline a13_histogram_quantile a21_gauge_timeline j01_align_by_position k01_latest_actions k03_latest_vector
m06_scaling_policy m07_decision_records p02_localise p06_route_normalisation p08_feature_validation q06_gap_summary
s01_event_decode s05b_point_upsert_table s13_access_log s14_pageview_dump s17_manifest_ingest s19_quality_report
t09_feature_vectors t09b_feature_stream t12_rate_limiter t12b_rate_limit_stream t13_minute_metrics_stream
t13b_sliding_metrics_stream t13c_limited_hits_stream t15_periodic_scoring t16_scheduled_replay w05_ewma_adjusted w10_second_features w16_upsample_linear w17_training_features""".split()
# trained models: their forecasts and scores have no SQL, see test_models.py and test_boosting.py
WITHOUT_SQL = {"m03_load_forecast", "m03b_forecast_error", "m08b_isolation_scores", "m09_anomaly_evaluation"}
ALL = catalog.queries()
NAMES = list(ALL) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    message, _, ok = compare(spark, connect(SF), name, ALL[name], catalog.oracle_sql().get(name), SF)
    assert ok, message


def test_only_models_are_without_sql():
    assert set(ALL) - set(catalog.oracle_sql()) == WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
