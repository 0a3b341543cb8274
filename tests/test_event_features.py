"""Per-event features against a plain model, and the stream against the batch plan."""

import math

import numpy as np
import pandas as pd
import pytest

from pulsegrid.plans import event_features as ef
from pulsegrid.streaming import features as sf

COLS = ["req_rate_1m", "req_rate_5m", "req_rate_15m", "req_rate_30m", "latency_std_5m", "latency_std_15m",
        "req_max_5m", "req_max_15m", "ewma_03", "ewma_07", "rate_of_change", "autocorr_lag1"]


def model(events: pd.DataFrame) -> pd.DataFrame:
    """One endpoint after the other, one event after the other."""
    out = []
    for endpoint, group in events.groupby("endpoint"):
        counts, latencies, rates = {}, {}, []
        e3 = e7 = None
        for ev in group.sort_values(["ms", "event_id"]).itertuples():
            bucket = ev.ms // 1000 * 1000
            counts[bucket] = counts.get(bucket, 0) + 1
            latencies[bucket] = ev.latency_ms

            def inside(store, seconds):
                return [v for b, v in store.items() if ev.ms - seconds * 1000 <= b <= ev.ms]

            rate = sum(inside(counts, 60)) / 60
            before = rates[-1] if rates else 0.0
            e3 = rate if e3 is None else 0.3 * rate + 0.7 * e3
            e7 = rate if e7 is None else 0.7 * rate + 0.3 * e7
            rates.append(rate)
            recent = np.array(rates[-60:])
            x, y = recent[1:], recent[:-1]
            corr = 0.0
            if len(recent) >= 3 and np.ptp(x) > 0 and np.ptp(y) > 0:
                corr = np.corrcoef(x, y)[0, 1]
            std = [np.std(v, ddof=1) if len(v) > 1 else 0.0 for v in (inside(latencies, 300), inside(latencies, 900))]
            out.append([ev.event_id, rate, sum(inside(counts, 300)) / 300, sum(inside(counts, 900)) / 900,
                        sum(inside(counts, 1800)) / 1800, *std, max(inside(counts, 300)), max(inside(counts, 900)),
                        e3, e7, (rate - before) / max(before, 1.0), corr])
    return pd.DataFrame(out, columns=["event_id", *COLS]).sort_values("event_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(11)
    n = 700
    ms = np.sort(rng.integers(0, 4_200_000, n))
    ms[100:160] = ms[100]  # a burst in one millisecond
    ms[::7] -= ms[::7] % 1000  # events exactly on a second
    ms = np.sort(ms) + 1_709_500_000_000
    return pd.DataFrame({
        "event_id": np.arange(n) + (1 << 21), "ms": ms, "ts": pd.to_datetime(ms, unit="ms"),
        "endpoint": np.where(rng.random(n) < 0.7, "/hot", "/cold"), "latency_ms": rng.gamma(2, 20, n).round(3)})


def check(got: pd.DataFrame, want: pd.DataFrame):
    got = got.sort_values("event_id").reset_index(drop=True)
    assert got["event_id"].tolist() == want["event_id"].tolist()
    for c in COLS:
        np.testing.assert_allclose(got[c], want[c], atol=1e-7, err_msg=c)


@pytest.mark.parametrize("hot_second", [ef.HOT_SECOND, 3])
def test_batch_matches_model(spark, events, hot_second, monkeypatch):
    monkeypatch.setattr(ef, "ID_BLOCK_BITS", 3)
    df = spark.createDataFrame(events.drop(columns="ms").sample(frac=1, random_state=1))
    got = ef.feature_vectors(df, hot_second=hot_second, rows=256).toPandas()
    check(got, model(events))


def test_small_slices(spark, events, monkeypatch):
    monkeypatch.setattr(ef, "SLICE", 1900)
    df = spark.createDataFrame(events.drop(columns="ms"))
    check(ef.feature_vectors(df, rows=256).toPandas(), model(events))


def test_stream_in_parts_matches_model(spark, events, tmp_path):
    """Micro-batches cut inside a second and right after a burst; one of them is replayed."""
    step = sf.feature_batch(str(tmp_path / "out"), str(tmp_path / "state"), rows=256)
    cuts = [0, 130, 131, 400, 700]
    ordered = events.sort_values(["ms", "event_id"]).drop(columns="ms")
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = spark.createDataFrame(ordered.iloc[a:b])
        step(part, i)
        if i == 2:
            step(part, i)
    check(sf.read_vectors(spark, str(tmp_path / "out")).toPandas(), model(events))


def test_late_events_are_set_aside(spark, events, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("out", "state", "late")}
    step = sf.feature_batch(paths["out"], paths["state"], late=paths["late"])
    df = spark.createDataFrame(events.drop(columns="ms"))
    step(df, 0)
    step(df, 1)
    late = spark.read.parquet(paths["late"]).filter("batch_id = 1").count()
    top = events["ms"].max() // 1000
    assert late == (events["ms"] // 1000 < top - 1800).sum() > 0


def test_idle_endpoints_are_forgotten(spark):
    rows = [("/old", 100, 1, 5.0), ("/new", 10_000, 1, 5.0), ("/new", 9_000, 1, 7.0), ("/new", 8_000, 1, 7.0)]
    df = spark.createDataFrame(rows, "endpoint string, sec long, cnt long, last_latency double")
    kept = {(r["endpoint"], r["sec"]): r["last_latency"] for r in sf.retain_seconds(df, idle_ttl=3600).collect()}
    assert kept == {("/new", 10_000): 5.0, ("/new", 9_000): None}
    assert sf.retain_seconds(df).filter("endpoint = '/old'").count() == 1


def test_calendar_of_stream_counts_monday_as_one(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "event_id": [1], "endpoint": ["a"], "latency_ms": [1.0], "ts": [pd.Timestamp("2024-03-04 06:00:00")]}))
    row = ef.feature_vectors(df).first()  # a Monday
    assert row["dow_sin"] == pytest.approx(math.sin(2 * math.pi / 7))
    assert row["hour_sin"] == pytest.approx(1.0) and row["is_weekend"] == 0.0
