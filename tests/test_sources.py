"""File sources, manifest and quality report on the pinned examples."""

import gzip
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import quality
from pulsegrid.operators import series as S
from pulsegrid.plans.training import build_features, build_training_table
from pulsegrid.schema import FEATURE_COLS, LABEL_COLS
from pulsegrid.sources import events as E
from pulsegrid.sources import sinks
from pulsegrid.sources.manifest import ingest, load_manifest
from pulsegrid.sources.traces import load_series, read_columns


def csv(path, **columns):
    pd.DataFrame(columns).to_csv(path, index=False)
    return str(path)


def load(spark, path, **cfg):
    return load_series(spark, {"name": "x", "path": path, **cfg}).toPandas().sort_values("timestamp").reset_index(drop=True)


def hours(n, start="2024-01-01"):
    return pd.date_range(start, periods=n, freq="h").astype(str)


def test_generic_series(spark, tmp_path):
    p = csv(tmp_path / "a.csv", ts=hours(48), val=np.arange(48.0))
    got = load(spark, p, timestamp_col="ts", value_col="val", resample="1h", multiplier=2.0)
    assert got["value"].tolist() == [2.0 * i for i in range(48)]


def test_missing_columns_file_and_format_are_empty(spark, tmp_path):
    assert load(spark, csv(tmp_path / "b.csv", col_a=[1], col_b=[2])).empty
    assert load(spark, str(tmp_path / "none.csv")).empty
    assert load(spark, str(tmp_path / "none.xlsx")).empty
    assert read_columns(spark, str(tmp_path / "none.parquet")) is None


def test_time_zone(spark, tmp_path):
    p = csv(tmp_path / "c.csv", timestamp=hours(10, "2024-07-01 12:00"), value=[100.0] * 10)
    assert load(spark, p, resample="1h", timezone="US/Pacific")["timestamp"][0].hour == 19


def test_offsets_in_the_text_win_over_the_zone(spark, tmp_path):
    p = csv(tmp_path / "c2.csv", timestamp=["2024-07-01T12:00:00+02:00", "2024-07-01 12:00:00"], value=[1.0, 1.0])
    got = load(spark, p, resample="1h", timezone="US/Pacific", agg="max", missing_data_policy="drop")
    assert got["timestamp"].dt.hour.tolist() == [10, 19]


def test_clip(spark, tmp_path):
    got = load(spark, csv(tmp_path / "d.csv", timestamp=hours(20), value=np.arange(-5.0, 15.0)),
               resample="1h", clip_min=0, clip_max=10)
    assert got["value"].min() == 0 and got["value"].max() == 10


HOLES = [100, None, None, 200, None, 300, None, None, None, 400]


@pytest.mark.parametrize("agg, policy, want", [
    ("sum", "ffill", [100, 0, 0, 200, 0, 300, 0, 0, 0, 400]),
    ("mean", "ffill", [100, 100, 100, 200, 200, 300, 300, 300, 300, 400]),
    ("mean", "interpolate", [100, 400 / 3, 500 / 3, 200, 250, 300, 325, 350, 375, 400])])
def test_missing_values(spark, tmp_path, agg, policy, want):
    p = csv(tmp_path / "e.csv", timestamp=hours(10), value=HOLES)
    assert load(spark, p, resample="1h", agg=agg, missing_data_policy=policy)["value"].tolist() == pytest.approx(want)


@pytest.mark.parametrize("lines", [
    ["en A 1000 0", "en B 250 0", "en C 300 0"],
    ["en A desktop 1000 x", "en B mobile 250 y", "en C 300 0", "junk"]])
def test_pageview_dump(spark, tmp_path, lines):
    p = tmp_path / "pageviews-20240101-050000.gz"
    with gzip.open(p, "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = load(spark, str(p), adapter="wikimedia")
    assert got["value"].tolist() == [1550.0] and got["timestamp"][0] == pd.Timestamp("2024-01-01 05:00")


def test_access_log(spark, tmp_path):
    p = tmp_path / "access.log"
    p.write_text("".join(f'h - - [01/Jul/1995:00:{t} -0400] "GET / HTTP/1.0" 200 1\n' for t in ("00:01", "00:59", "01:15"))
                 + "no stamp\nh - - [not a time] x\n")
    got = load(spark, str(p), adapter="nasa_http")
    assert list(zip(got["timestamp"].dt.strftime("%H:%M"), got["value"])) == [("04:00", 2.0), ("04:01", 1.0)]


def test_function_trace_in_five_minutes(spark, tmp_path):
    p = csv(tmp_path / "f.csv", end_timestamp=pd.date_range("2024-01-01", periods=60, freq="min").astype(str),
            invocations=range(60), app=["a"] * 60)
    got = load(spark, p, adapter="azure_functions", resample="5min")
    assert len(got) == 12 and got["value"].sum() == sum(range(60))


@pytest.mark.parametrize("stamp", [1_710_000_000_000_000, 1_710_000_000_000, 1_710_000_000, "2024-03-09 16:00:00"])
def test_epoch_units(spark, tmp_path, stamp):
    p = csv(tmp_path / "g.csv", time=[stamp] * 3, cpu_usage=[1.0, 2.0, "x"])
    got = load(spark, p, adapter="google_cluster", resample="1h", agg="mean")
    assert got["value"].tolist() == [1.5] and got["timestamp"][0] == pd.Timestamp("2024-03-09 16:00")


def test_epoch_unit_can_be_given(spark, tmp_path):
    p = csv(tmp_path / "h.csv", start_time=[3_600_000_000], avg_cpu=[1.0])
    got = load(spark, p, adapter="google_cluster", epoch_unit="us", resample="1h")
    assert got["timestamp"][0] == pd.Timestamp("1970-01-01 01:00")


def test_manifest_errors(spark):
    with pytest.raises(ValueError):
        load_manifest({"sources": "x"})
    with pytest.raises(RuntimeError):
        ingest(spark, {"sources": [{"name": "a", "enabled": False, "path": "p"}]})
    with pytest.raises(RuntimeError):
        build_training_table(spark, {"sources": [{"name": "a", "enabled": True, "path": "/nonexistent.csv"}]})


def test_fusion(spark):
    t = pd.date_range("2024-01-01", periods=5, freq="h")
    rows = pd.concat([pd.DataFrame({"timestamp": t, "value": v, "weight": w}) for v, w in ((100.0, 1.0), (200.0, 3.0))])
    df = spark.createDataFrame(rows)
    assert {r["req_rate_1m"] for r in S.fuse(df, "weighted_mean").collect()} == {175.0}
    assert {r["req_rate_1m"] for r in S.fuse(df, "sum").collect()} == {300.0}


def test_manifest_to_training_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    stamps = pd.date_range("2024-01-01", periods=300, freq="min")
    stamps = stamps[:150].append(stamps[180:])
    p = csv(tmp_path / "t.csv", timestamp=stamps.astype(str), value=rng.gamma(2, 50, 270))
    manifest = {
        "fusion_mode": "sum", "output_path": str(tmp_path / "out.parquet"), "quality_report_path": str(tmp_path / "q"),
        "sources": [{"name": "s", "enabled": True, "path": p, "agg": "mean", "missing_data_policy": "drop"}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(manifest))
    features, report = build_training_table(spark, str(path))
    stored = spark.read.parquet(manifest["output_path"])
    assert stored.count() == 270 and stored.columns == ["timestamp", *FEATURE_COLS, *LABEL_COLS]
    r = spark.read.json(manifest["quality_report_path"]).first()
    assert r["timestamp_continuity"]["total_gaps"] == 1 and r["timestamp_continuity"]["max_gap_seconds"] == 1860.0
    assert r["source_contributions"][0]["rows"] == 270 and r["null_free"]


def test_absent_features_are_zero(spark):
    out = sinks.training_columns(spark.createDataFrame([(1.0,)], "req_rate_1m double"))
    row = out.first()
    assert row["req_rate_1m"] == 1.0 and row["queue_depth"] == 0.0 and out.schema["ewma_03"].dataType.simpleString() == "float"


def test_features_by_hand(spark):
    r = [10.0, 20.0, 40.0, 10.0, 5.0, 300.0, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"timestamp": pd.date_range("2024-01-06", periods=7, freq="min"), "req_rate_1m": r}))
    got = build_features(df).toPandas().sort_values("timestamp")
    assert got["req_rate_5m"].tolist() == pytest.approx([10, 15, 70 / 3, 20, 17, 75, 71.2])
    assert got["req_max_5m"].tolist() == [10, 20, 40, 40, 40, 300, 300]
    assert got["ewma_03"].tolist()[:3] == pytest.approx([10, 13, 21.1])
    assert got["rate_of_change"].tolist()[:3] == pytest.approx([0, 1, 1])
    assert got["future_req_rate_5m"].tolist() == [300, 1, 1, 1, 1, 1, 1]
    assert got["is_surge"].tolist() == [0, 0, 1, 0, 0, 1, 0]  # median 10
    assert got["is_weekend"].tolist() == [1.0] * 7


def test_quality_gap(spark):
    t = pd.date_range("2024-01-01", periods=30, freq="min").append(pd.date_range("2024-01-01 02:30", periods=30, freq="min"))
    df = spark.createDataFrame(pd.DataFrame({"timestamp": t, "value": 1.0}))
    share = spark.createDataFrame([("a", 60)], "source string, rows long")
    r = quality.report(df, share).first()
    assert r["timestamp_continuity"]["total_gaps"] == 1 and r["timestamp_continuity"]["max_gap_seconds"] == 7260.0
    assert r["duplicate_timestamps"] == 0 and r["outlier_ratio"] == 0.0 and r["date_range"]["span_days"] == 0.12


@pytest.mark.parametrize("text, endpoint, millis, latency", [
    ('{"endpoint": "/a", "ts": 5000, "latency_ms": 3}', "/a", 5000, 3.0),
    ('{"ts": 5000, "latency_avg": 4.5, "latency": 9}', "unknown", 5000, 4.5),
    ('{"timestamp": "1970-01-01T00:00:07.250Z", "ts": 1, "latency": "8"}', "unknown", 7250, 8.0),
    ('{"timestamp": 12, "endpoint": "/b"}', "/b", 1000, 10.0),
    ('{"ts": 1, "timestamp": "soon"}', None, None, None), ("{broken", None, None, None)])
def test_decode(spark, text, endpoint, millis, latency):
    df = spark.createDataFrame([(text, 1000)], "value string, at long").withColumn("record_time", F.timestamp_millis("at"))
    good, bad = E.split_malformed(E.decode(df))
    if endpoint is None:
        assert good.count() == 0 and bad.count() == 1
    else:
        row = good.select("endpoint", F.unix_millis("ts").alias("ms"), "latency_ms").first()
        assert tuple(row) == (endpoint, millis, latency)
