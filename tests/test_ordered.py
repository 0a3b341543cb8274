"""Block-wise windows, carries and percentiles against pandas on small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ordered, quantiles
from pulsegrid.operators import rolling as R
from pulsegrid.operators import series as S

N = 1500


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    minutes = np.sort(rng.choice(np.arange(4000), N, replace=False))
    r = rng.gamma(2.0, 30.0, N).round(2)
    r[400:600] = 7.5  # a flat stretch
    pdf = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, unit="min"), "req_rate_1m": r})
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=3))


def test_time_index(frame):
    pdf, df = frame
    got = ordered.time_index(df, seconds=3600).toPandas().sort_values("timestamp")
    assert got["idx"].tolist() == list(range(N))


def test_row_index_with_equal_timestamps(spark):
    df = spark.range(5000).select(F.lit(1).alias("ts"), (F.col("id") * 7919 % 5000).alias("id"))
    got = ordered.row_index(df, ["ts", "id"]).toPandas().sort_values("id")
    assert got["idx"].tolist() == list(range(5000))


def test_blocks_match_pandas(frame):
    pdf, df = frame
    out = R.apply(
        ordered.time_index(df),
        R.rolling_mean({"m30": 30}), R.rolling_max({"x15": 15}), R.rolling_std({"s15": 15}, R.RATE),
        R.ewma({"e3": 0.3, "e7": 0.7}), R.ewma({"a3": 0.3}, adjust=True), R.rate_of_change(), R.autocorrelation(),
        R.lead_value("next5"), R.future_mean("fut", rows=40),
        R.wide_max({"w50": 50}, R.RATE), R.wide_std({"d50": 50}, R.RATE), rows=256,
    ).toPandas().sort_values("timestamp").reset_index(drop=True)
    r = pdf["req_rate_1m"]
    prev = r.shift(1).fillna(r[0])
    corr = r.rolling(60, min_periods=2).corr(r.shift(1))
    flat = (r.rolling(60, min_periods=1).std() < 1e-9) | (r.shift(1).rolling(60, min_periods=1).std() < 1e-9)
    want = {
        "m30": r.rolling(30, min_periods=1).mean(), "x15": r.rolling(15, min_periods=1).max(),
        "s15": r.rolling(15, min_periods=1).std().fillna(0), "e3": r.ewm(alpha=0.3, adjust=False).mean(),
        "e7": r.ewm(alpha=0.7, adjust=False).mean(), "a3": r.ewm(alpha=0.3).mean(),
        "rate_of_change": (r - prev) / np.maximum(prev, 1.0),
        "autocorr_lag1": corr.where(~flat, 0.0).replace([np.inf, -np.inf], 0.0).fillna(0.0),
        "next5": r.shift(-5), "fut": r.rolling(40).mean().shift(-40),
        "w50": r.rolling(50, min_periods=1).max(), "d50": r.rolling(50, min_periods=1).std().fillna(0),
    }
    for name, series in want.items():
        np.testing.assert_allclose(out[name].to_numpy(dtype=float), series.to_numpy(), atol=2e-6, err_msg=name)


def test_block_must_exceed_halo(frame):
    with pytest.raises(ValueError):
        ordered.with_halo(frame[1], "idx", 100, trailing=80, leading=20)


@pytest.mark.parametrize("policy", ["ffill", "interpolate", "zero", "drop", "other"])
def test_missing_policies_across_slices(spark, policy):
    rng = np.random.default_rng(5)
    v = rng.normal(size=600).round(3)
    v[rng.random(600) < 0.5] = np.nan
    v[:40], v[150:420], v[-30:] = np.nan, np.nan, np.nan  # gaps longer than a slice
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=600, freq="15min"), "value": v})
    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    got = S.handle_missing(df, policy).toPandas().sort_values("timestamp")
    s = pdf["value"]
    want = {"ffill": s.ffill().bfill(), "interpolate": s.interpolate().bfill().ffill(), "zero": s.fillna(0.0)}.get(
        policy, s.dropna())
    np.testing.assert_allclose(got["value"].to_numpy(), want.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("keyed", [False, True])
def test_exact_percentiles_with_ties(spark, keyed):
    """More values than the sketch keeps exactly, a third of them equal."""
    df = spark.range(120_000).select(
        (F.col("id") % 2).alias("k"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.abs(F.hash("id")) % 100_003 / 7.0).alias("x"))
    ps = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = quantiles.exact_percentiles(df, "x", ps, ["k"] if keyed else []).toPandas()
    pdf = df.toPandas()
    for _, row in got.iterrows():
        x = pdf["x"] if not keyed else pdf.loc[pdf["k"] == row["k"], "x"]
        for name, p in ps.items():
            assert row[name] == pytest.approx(np.quantile(x, p), abs=1e-9)
    assert len(got) == (2 if keyed else 1)


def test_odd_resample_interval_counts_from_midnight(spark):
    rng = np.random.default_rng(2)
    t = pd.Timestamp("2024-03-01 05:13:20") + pd.to_timedelta(np.sort(rng.integers(0, 200_000, 300)), unit="s")
    pdf = pd.DataFrame({"timestamp": t, "value": rng.integers(0, 50, 300).astype(float)})
    for agg in ("sum", "mean", "max", "min"):
        got = S.resample(spark.createDataFrame(pdf), "7min", agg).toPandas().sort_values("timestamp")
        want = pdf.set_index("timestamp")["value"].resample("7min").agg(agg)
        assert got["timestamp"].tolist() == want.index.tolist()
        np.testing.assert_allclose(got["value"].to_numpy(dtype=float), want.to_numpy())
        assert got["idx"].tolist() == list(range(len(want)))
