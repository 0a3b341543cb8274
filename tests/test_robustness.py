"""Inputs beyond the clean, sorted, complete ones of the test tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import models as ML
from pulsegrid.operators import rolling as R
from pulsegrid.operators import series as S
from pulsegrid.operators.quantiles import exact_percentiles
from pulsegrid.session import scratch
from pulsegrid.sources import events, traces


@pytest.mark.parametrize("level", [0.0, 1e6, 1e9])
def test_autocorrelation_at_any_level(spark, level):
    i = np.arange(400)
    x = pd.Series(level + 10 * np.sin(i / 5))
    x[200:300] = level
    df = spark.createDataFrame(pd.DataFrame({"idx": i, "req_rate_1m": x}))
    got = R.apply(df, R.autocorrelation()).orderBy("idx").toPandas()["autocorr_lag1"]
    x = x.to_numpy() - level  # exact here; pandas' own rolling correlation cancels at such levels
    for k in range(2, 400):
        pairs = slice(max(1, k - 59), k + 1)
        a, b = x[pairs], x[max(0, k - 60):k]
        flat = np.ptp(a) == 0 or np.ptp(b) == 0
        assert got[k] == pytest.approx(0.0 if flat else np.corrcoef(a, b)[0, 1], abs=1e-6)


def test_time_forms(spark):
    forms = {"300": "1970-01-01 00:05:00", "1700000000": "2023-11-14 22:13:20", "01/02/2024 10:00": "2024-01-02 10:00:00",
             "2024/01/02 10:00": "2024-01-02 10:00:00", "20240102": "2024-01-02 00:00:00", "Jan 2 2024": "2024-01-02 00:00:00",
             "2024-01-02T10:00:00+02:00": "2024-01-02 08:00:00", "12:30": None, "no time": None, "": None}
    df = spark.createDataFrame([(k,) for k in forms], "t string").select("t", S.parse_time(F.col("t")).cast("string").alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == forms


def test_instants_have_seconds_and_an_offset(spark):
    rows = [('{"timestamp": "2024-01-01T00:00:00+02:00"}', dt.datetime(2023, 12, 31, 22)), ('{"timestamp": "2024-01-01T00:00:00Z"}', dt.datetime(2024, 1, 1)),
            ('{"timestamp": "2024-01-01T00:00Z"}', None), ('{"timestamp": "2024-01-01T00:00:00"}', None)]
    df = spark.createDataFrame([(v,) for v, _ in rows], "value string").withColumn("record_time", F.current_timestamp())
    got = {r["value"]: None if r["malformed"] else r["ts"] for r in events.decode(df).collect()}
    assert got == dict(rows)


def test_missing_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 7.0)], "k string, v double")
    assert {r["k"]: r["p"] for r in exact_percentiles(df, "v", {"p": 0.5}, ["k"]).collect()} == {None: 2.0, "a": 6.0}
    stamped = df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000))).withColumnRenamed("v", "value")
    assert {r["k"]: r["value"] for r in S.resample(stamped, "1min", "sum", keys=["k"]).collect()} == {None: 4.0, "a": 12.0}


def test_gaps_next_to_a_plain_scan(spark):
    rng = np.random.default_rng(3)
    stamps = np.sort(rng.choice(np.arange(0, 400_000), 900, replace=False)) * 1_000_000 + rng.integers(0, 999_999, 900)
    keyed = [(k, int(t)) for t in np.concatenate([stamps, stamps[:50]]) for k in ("x", None)]
    df = spark.createDataFrame(keyed, "k string, us long").select("k", F.timestamp_micros("us").alias("timestamp"))
    got = S.gaps(df, "7min", keys=["k"]).select(F.unix_micros("after"), F.unix_micros("before"), "k").collect()
    want = {(int(a), int(b)) for a, b in zip(stamps[:-1], stamps[1:]) if b - a > 14 * 60_000_000}
    assert {(r[0], r[1]) for r in got if r["k"] == "x"} == want == {(r[0], r[1]) for r in got if r["k"] is None}


def test_small_and_absent_inputs(spark, tmp_path):
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 4.0)], "timestamp timestamp, value double")
    assert [r["value"] for r in S.upsample_linear(one, 3).orderBy("i").collect()] == [4.0, 4.0, 4.0]
    assert traces.page_day_matrix(spark, str(tmp_path / "absent.csv")).count() == 0


def test_models_keep_rows_and_can_be_stored(spark):
    rng = np.random.default_rng(1)
    t = pd.date_range("2024-01-01", periods=400, freq="min")
    pdf = pd.DataFrame({"timestamp": t, "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["future_req_rate_5m"] = 3 * pdf["a"] + 10
    df = spark.createDataFrame(pdf)
    model = ML.fit_forecaster(df, features=["a", "b"], trees=3, depth=3)
    holes = df.withColumn("a", F.when(F.minute("timestamp") % 2 == 0, F.col("a")))
    predicted = model.predict(holes)
    assert predicted.count() == 400 and predicted.where("main IS NULL OR lower > upper").count() == 0
    path = scratch(spark, "model")
    model.save(path)
    again = ML.Forecaster.load(spark, path).predict(holes).select("timestamp", "main", "lower", "upper")
    assert again.exceptAll(predicted.select("timestamp", "main", "lower", "upper")).count() == 0
    forest = ML.fit_isolation_forest(df, "timestamp", features=["a", "b"], trees=5, sample=64)
    path = scratch(spark, "forest")
    forest.save(spark, path)
    other = ML.IsolationForest.load(spark, path)
    assert other.predict(df).where("is_anomaly").count() == forest.predict(df).where("is_anomaly").count() > 0


def test_upsert_and_newest_read_only_the_days_they_need(spark):
    from pulsegrid.operators.latest import latest_field_percent
    from pulsegrid.sources import sinks

    path = scratch(spark, "points")
    rows = [("e", dt.datetime(2024, 1, d, 12, m), d * 100 + m, float(m)) for d in range(1, 9) for m in range(3)]
    schema = "endpoint string, timestamp timestamp, arrival long, value double"
    sinks.upsert_points(spark.createDataFrame(rows, schema), path)
    sinks.upsert_points(spark.createDataFrame([("e", dt.datetime(2024, 1, 3, 12, 0), 9999, 42.0)], schema), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 24 and stored.where("value = 42").count() == 1

    def filters(df):
        return [line for line in df._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]

    assert all("2024-01-03" in line for line in filters(sinks.touched_days(stored, [dt.date(2024, 1, 3)])))
    assert all("2024-01-07" in line for line in filters(latest_field_percent(stored, "value")))
    assert latest_field_percent(stored, "value").first()["percent"] == 200.0
    assert sinks.retain_days(stored, 2).select("day").distinct().count() == 3


def test_a_cycle_cut_by_a_micro_batch_is_decided_once(spark):
    from pulsegrid.streaming import scoring

    def bounds(df):
        return df.withColumns({"main": F.col("x"), "lower": F.col("x") * 0.9, "upper": F.col("x") * 1.1})

    audit, state = scratch(spark, "audit"), scratch(spark, "state")
    step = scoring.scoring_batch(audit, state, bounds)
    t0 = dt.datetime(2024, 1, 1)
    for batch_id, seconds in enumerate([(0, 1, 6), (7, 8), (9, 11)]):
        rows = [("api", t0 + dt.timedelta(seconds=s), 1000.0 + s) for s in seconds]
        step(spark.createDataFrame(rows, "service string, timestamp timestamp, x double"), batch_id)
    assert [r["timestamp"].second for r in spark.read.parquet(audit).orderBy("timestamp").collect()] == [1, 6, 11]
