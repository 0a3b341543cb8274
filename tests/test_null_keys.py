"""Rows whose key is NULL are a series of their own: none is lost, and all get what a named one gets."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.operators.metrics import gauge_timeline, phase_summary
from pulsegrid.plans.event_features import feature_vectors, with_infra
from pulsegrid.plans.training import build_features, future_rate, surge_flags

START = datetime(2024, 3, 1)


def requests(spark, n=120):
    rng = random.Random(2)
    rows = [(k, START + timedelta(milliseconds=rng.randrange(400_000)), rng.choice(["a", None]), float(rng.randrange(100))) for k in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string, latency_ms double")


def same(frame, keys):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.drop(*keys).collect())


def test_vectors_of_events_without_endpoint(spark):
    events = requests(spark)
    named = events.withColumn("endpoint", F.coalesce("endpoint", F.lit("none")))
    for hot in (1 << 20, 0):
        got = feature_vectors(events, hot_second=hot)
        assert got.count() == 120 and got.where("endpoint IS NULL").count() == events.where("endpoint IS NULL").count()
        assert same(got, ["endpoint"]) == same(feature_vectors(named, hot_second=hot), ["endpoint"])


def test_infra_of_events_without_endpoint(spark):
    events = requests(spark)
    minutes = events.select("endpoint", F.date_trunc("minute", "ts").alias("minute")).distinct().withColumn("cpu_util", F.lit(0.25))
    assert with_infra(events, minutes).where("cpu_util = 0.25").count() == 120


def test_series_without_key(spark):
    rows = [(key, START + timedelta(minutes=k), float(k % 7 + (90 if k == 9 else 0))) for key in ("a", None) for k in range(10)]
    df = spark.createDataFrame(rows, "service string, timestamp timestamp, req_rate_1m double")
    for out in (surge_flags(df, keys=["service"]), build_features(df, keys=["service"])):
        assert out.count() == 20
    flags = surge_flags(df, keys=["service"])
    assert same(flags.where("service = 'a'"), ["service"]) == same(flags.where("service IS NULL"), ["service"])
    ahead = future_rate(df.withColumn("idx", F.minute("timestamp")), keys=["service"])
    assert ahead.where("future_req_rate_5m IS NULL").isEmpty() and ahead.count() == 20


def test_gauges_and_phases_without_key(spark):
    rows = [(key, START + timedelta(minutes=2 * k), float(k), 200, k) for key in ("a", None) for k in range(5)]
    df = spark.createDataFrame(rows, "service string, timestamp timestamp, replicas double, status int, latency_ms int")
    grid = gauge_timeline(df, ["replicas"], keys=["service"])
    assert grid.count() == 18 and grid.where("replicas IS NULL").isEmpty()
    assert phase_summary(df, "service", ts="timestamp").count() == 2
