"""Rate limiter and scaling policy against hand-written sequences and plain models."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decisions as D
from pulsegrid.operators import limiter
from pulsegrid.operators.metrics import limited_hits
from pulsegrid.session import scratch
from pulsegrid.streaming import limiter as stream


def run_limiter(spark, rows, **kw):
    pdf = pd.DataFrame(rows, columns=["event_id", "client_id", "path", "ms"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    return limiter.rate_limit(df, **kw).toPandas().sort_values("event_id").reset_index(drop=True)


def test_limit_per_client_and_bypass(spark):
    rows = [(0, "c1", "/health", 0), (1, "c1", "/health", 1), (2, "c1", "/api/x", 2), (3, "c1", "/api/x", 3),
            (4, "c1", "/api/x", 4), (5, "c2", "/api/x", 5), (6, "c1", "/api/x", 60_001), (7, "c1", "/api/x", 60_002)]
    got = run_limiter(spark, rows, limit=2)
    # the window opened at 2 ends at 60002: the request at 60001 is still in it
    assert got["allowed"].tolist() == [True, True, True, True, False, True, False, True]


def plain(rows, limit):
    windows, out = {}, {}
    for event_id, client, _, ms in sorted(rows, key=lambda r: (r[3], r[0])):
        start, used = windows.get(client, (None, 0))
        if start is None or ms >= start + 60_000:
            start, used = ms, 0
        windows[client] = (start, used + 1)
        out[event_id] = used + 1 <= limit
    return [out[k] for k in sorted(out)]


def busy_rows(seed=4):
    rng = np.random.default_rng(seed)
    ms = rng.integers(0, 3_000_000, 3000)
    ms[:200] = 77_000
    clients = np.where(rng.random(3000) < 0.4, "busy", rng.integers(0, 20, 3000).astype(str))
    ids = rng.permutation(3000) * 7_919_000_111  # not dense
    return [(int(i), str(c), "/api/x", int(t)) for i, c, t in zip(ids, clients, ms)]


@pytest.mark.parametrize(("chunk_ms", "chunks"), [(60_000, 32), (90_000, 3), (60_000, 1), (3_600_000, 32)])
def test_chunks_do_not_change_decisions(spark, chunk_ms, chunks):
    rows = busy_rows()
    assert run_limiter(spark, rows, limit=5, chunk_ms=chunk_ms, chunks=chunks)["allowed"].tolist() == plain(rows, 5)


def test_joins_replanned_while_running_keep_clients_whole(spark):
    """A join whose smaller side (windows, not requests) turns out small while running is made a broadcast that reads
    the shuffled requests where they lie."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "50KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = busy_rows(6)
        assert run_limiter(spark, rows, limit=5)["allowed"].tolist() == plain(rows, 5)
        assert run_limiter(spark, rows, limit=5, chunk_ms=60_000, chunks=3)["allowed"].tolist() == plain(rows, 5)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_missing_client_or_path_is_limited(spark):
    rows = [(0, None, "/api/x", 1), (1, None, None, 2), (2, "", "/api/x", 3), (3, "c", None, 4), (4, None, "/health", 5)]
    df = spark.createDataFrame(rows, "event_id long, client_id string, path string, ms long")
    got = limiter.rate_limit(df.withColumn("ts", F.timestamp_millis("ms")).drop("ms"), limit=2).orderBy("event_id").collect()
    assert [r["client_id"] for r in got] == [None, None, "", "c", None]
    assert [r["window_count"] for r in got] == [1, 2, 3, 1, None]
    assert [r["allowed"] for r in got] == [True, True, False, True, True]


@pytest.mark.parametrize("batch_rows", [20, 10_000])
def test_stream_in_parts_equals_whole(spark, batch_rows):
    """Shuffled rows, several micro-batches, any Arrow batch size: the same decisions, all requests."""
    rows = sorted(busy_rows(9), key=lambda r: r[3]) + [(-1, "busy", "/health", 3_000_001)]
    out, state = scratch(spark, "decisions"), scratch(spark, "windows")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        step = stream.limit_batch(out, state, limit=5)
        for batch_id, part in enumerate([rows[:1000], rows[1000:1001], rows[1001:]]):
            shuffled = [part[k] for k in np.random.default_rng(batch_id).permutation(len(part))]
            df = spark.createDataFrame(shuffled, "event_id long, client_id string, path string, ms long")
            step(df.withColumn("ts", F.timestamp_millis("ms")).drop("ms"), batch_id)
        got = stream.read_decisions(spark, out).orderBy("event_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["event_id"] for r in got] == sorted(r[0] for r in rows)
    assert [r["allowed"] for r in got] == [True, *plain(rows[:-1], 5)]


def test_stream_replanned_while_running_keeps_clients_whole(spark):
    """The same for micro-batches, and for the hits that are counted behind them."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "50KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rows = sorted(busy_rows(8), key=lambda r: r[3])
    out, state = scratch(spark, "decisions"), scratch(spark, "windows")
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        step = stream.limit_batch(out, state, limit=5)
        for batch_id, part in enumerate([rows[:1500], rows[1500:]]):
            df = spark.createDataFrame(part, "event_id long, client_id string, path string, ms long")
            step(df.withColumn("ts", F.timestamp_millis("ms")).drop("ms"), batch_id)
    finally:
        for name in settings:
            spark.conf.unset(name)
    decisions = stream.read_decisions(spark, out)
    assert [r["allowed"] for r in decisions.orderBy("event_id").collect()] == plain(rows, 5)
    expected = Counter((ms // 300_000 * 300, client) for (_, client, _, ms), passed in zip(sorted(rows), plain(rows, 5)) if not passed)
    hits = limited_hits(decisions).select(F.unix_seconds("window_start").alias("at"), "client_id", "hits").collect()
    assert {(r["at"], r["client_id"]): r["hits"] for r in hits} == expected


SEQUENCE = [(0, 1600, "SCALE_OUT", 3), (30, 1600, "COOLDOWN", 3), (60, 1600, "SCALE_OUT", 4),
            (120, 100, "HOLD", 4), (239, 100, "HOLD", 4), (240, 100, "SCALE_IN", 2)]


def test_policy_sequence_in_one_or_two_runs(spark):
    t0 = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame([("api", t0 + pd.Timedelta(seconds=s), float(r)) for s, r, *_ in SEQUENCE],
                       columns=["service", "timestamp", "predicted_rate"])
    whole = D.scaling_policy(spark.createDataFrame(pdf)).toPandas().sort_values("timestamp")
    assert list(zip(whole["scale_action"], whole["target_replicas"])) == [(a, n) for *_, a, n in SEQUENCE]
    assert whole["scale_reason"].tolist()[1:5] == [
        "cooldown_active (30s remaining)", "predicted_rate=1600 > threshold=500", "scale_in_delay_started",
        "scale_in_pending (1s remaining)"]
    first = D.scaling_policy(spark.createDataFrame(pdf.iloc[:4]))
    second = D.scaling_policy(spark.createDataFrame(pdf.iloc[4:]), state=D.policy_state(first))
    assert second.toPandas().sort_values("timestamp")["scale_action"].tolist() == ["HOLD", "SCALE_IN"]


def test_policy_timer_survives_high_rate_and_cooldown():
    limits = D.PolicyLimits()
    state = D.PolicyState(6, 0, 100)
    assert D.policy_step(state, 110, 900.0, limits) == (state, "HOLD", 6, "at_max_replicas (6)")
    assert D.policy_step(state, 30, 100.0, limits)[0] == state
    assert D.policy_step(state, 110, 300.0, limits)[0].low_since is None
    # more replicas than needed above the threshold holds, too
    assert D.policy_step(D.PolicyState(5), 0, 600.0, limits)[1:] == ("HOLD", 5, "at_max_replicas (6)")


@pytest.mark.parametrize("confidence, rate, threshold, action, reason", [
    (0.80, 50, 0.75, "DISPATCH", "confidence_met"), (0.50, 50, 0.75, "HOLD", "below_threshold"),
    (0.90, 5, 0.75, "HOLD", "prediction_too_low"), (0.75, 25, 0.75, "DISPATCH", "confidence_met"),
    (0.749, 25, 0.75, "HOLD", "below_threshold"), (0.80, 20, 0.75, "DISPATCH", "confidence_met"),
    (0.60, 50, 0.50, "DISPATCH", "confidence_met")])
def test_gate(spark, confidence, rate, threshold, action, reason):
    df = spark.createDataFrame([(confidence, float(rate))], "confidence double, predicted_rate double")
    row = D.gate(df, threshold=threshold).first()
    assert (row["action_type"], row["reason"]) == (action, reason)


def test_score_and_bands(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (10.0, 0.0, 20.0), (float("nan"), 1.0, 2.0)],
                               "main double, lower double, upper double")
    rows = D.score(df).collect()
    assert (rows[0]["confidence"], rows[0]["action"]) == (1.0, "DISPATCH")
    assert (rows[1]["confidence"], rows[1]["action"]) == (0.0, "HOLD")
    assert rows[2]["action"] == "HOLD" or rows[2]["predicted_rate"] is None
    bands = spark.createDataFrame([(-0.05,), (-0.15,), (-0.5,)], "s double").select(D.anomaly_band(F.col("s"))).collect()
    assert [b[0] for b in bands] == ["anomaly", "suspicious", "normal"]


def test_feature_columns_are_checked():
    from pulsegrid.schema import FEATURE_COLS

    D.check_feature_columns(FEATURE_COLS)
    with pytest.raises(ValueError, match="26"):
        D.check_feature_columns(FEATURE_COLS[:-1])
    with pytest.raises(ValueError, match="queue_depth"):
        D.check_feature_columns(FEATURE_COLS[:-1] + ["other"])
