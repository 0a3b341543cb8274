"""From messages to audit records: clock, store, quarantine, message writers."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.catalog import control_queries as Q
from pulsegrid.catalog.inputs import tidy
from pulsegrid.operators import models
from pulsegrid.plans import event_features as ef
from pulsegrid.schema import FEATURE_COLS
from pulsegrid.sources import events as E
from pulsegrid.sources import sinks
from pulsegrid.streaming import control

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def due_by_hand(vectors, cycles, lookback=180, step=5):
    out = set()
    for c in cycles:
        now = at(c * step)
        for key in {v[1] for v in vectors}:
            seen = [(v[2], v[0]) for v in vectors if v[1] == key and v[2] is not None and now - dt.timedelta(seconds=lookback) <= v[2] <= now]
            if seen:
                out.add((key, now, max(seen)[1]))
    return out


def test_due_vectors_are_the_newest_of_three_minutes(spark):
    times = [0.0, 0.0, 4.999, 5.0, 12.3, 250.0, 250.001, 900.0, 4000.0]
    vectors = [(k, name, at(s)) for k, (name, s) in enumerate((n, s) for n in ("a", None, "") for s in times if not (n == "" and s > 300))]
    vectors += [(100, "a", None), (101, "a", at(900.0))]
    first = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) // 5
    cycles = [*range(0, 120), *range(175, 260), 800, 801, 836, 837]
    given = spark.createDataFrame(vectors, "event_id long, endpoint string, timestamp timestamp")
    ticks = spark.createDataFrame([(first + c,) for c in [*cycles, 3, 3]], "cycle long")
    got = control.due_vectors(given, ticks)
    rows = {(r["service"], r["timestamp"], r["event_id"]) for r in got.collect()}
    assert rows == due_by_hand(vectors, cycles) and got.count() == len(rows)
    assert control.due_vectors(given.limit(0), ticks).count() == 0
    assert control.due_vectors(given, ticks.limit(0)).count() == 0


def test_a_cycle_without_new_vectors_is_decided(spark, tmp_path):
    """One vector, then only the clock, by a real clock: every cycle has its row although nothing arrives."""
    store, audit, state, cp = (str(tmp_path / n) for n in ("store", "audit", "state", "cp"))
    vector = spark.range(1).select(F.lit(1).cast("long").alias("event_id"), F.lit("/api/a").alias("endpoint"),
                                   F.timestamp_seconds(F.lit(int(time.time()) - 100)).alias("timestamp"),
                                   *[F.lit(30.0).alias(c) for c in FEATURE_COLS])
    control.store_vectors(store)(vector, 0)
    running = control.start_scheduler(control.clock(spark), store, audit, state, cp, Q.predict, seconds=1)
    until = time.time() + 60
    cycles = []
    while time.time() < until and len(cycles) < 3:
        time.sleep(1)
        assert running.exception() is None
        if any(f.startswith("batch_id=") for f in (os.listdir(audit) if os.path.isdir(audit) else [])):
            cycles = [r["timestamp"] for r in spark.read.parquet(audit).select("timestamp").collect()]
    running.stop()
    assert len(cycles) >= 3 and len(set(cycles)) == len(cycles)


def test_ticks_before_any_vector_and_after_the_last(spark, tmp_path):
    store, audit, state = (str(tmp_path / n) for n in ("store", "audit", "state"))
    run = control.tick_batch(store, audit, state, Q.predict)

    def tick(batch_id, *seconds):
        run(spark.createDataFrame([(at(s),) for s in seconds], "tick timestamp"), batch_id)
        return spark.read.parquet(f"{audit}/batch_id={batch_id}").count()

    assert tick(0, 0, 5) == 0
    vector = spark.range(1).select(F.lit(1).cast("long").alias("event_id"), F.lit("/api/a").alias("endpoint"), F.lit(at(7)).alias("timestamp"),
                                   *[F.lit(30.0).alias(c) for c in FEATURE_COLS])
    control.store_vectors(store)(vector, 0)
    control.store_vectors(store)(vector, 0)  # a replay
    assert tick(1, 10, 12, 14, 15, 20) == 3
    assert tick(2, 20, 22) == 0  # decided before
    assert tick(3) == 0
    assert tick(4, 180, 185, 190, 195) == 2
    assert tick(4, 180, 185, 190, 195) == 2  # a replay


@needs_tables
def test_the_streams_equal_the_batch_with_a_trained_model(spark):
    """Three restarts of both streams against one batch; forecaster trained on the vectors themselves."""
    vectors = ef.feature_vectors(Q.requests(spark, SF).withColumn("endpoint", F.col("path")))
    kept = vectors.cache()
    labelled = kept.withColumn("future_req_rate_5m", F.col("req_rate_5m") * 10).groupBy("timestamp").agg(
        *[F.max(c).alias(c) for c in [*FEATURE_COLS, "future_req_rate_5m"]])
    model = models.fit_forecaster(labelled, trees=2, depth=3)
    folders = Q.run_system(spark, SF, model.predict)
    lo, *_, hi = Q._edges(spark, SF)
    records, _ = control.scheduled_decisions(kept, spark.range(lo, hi).withColumnRenamed("id", "cycle"), model.predict)
    want = sorted(map(str, tidy(records).collect()))
    got = sorted(map(str, tidy(spark.read.parquet(folders["audit"]).drop("batch_id")).collect()))
    assert got == want and len(got) > 1000
    broken = spark.read.parquet(folders["quarantine"])
    assert broken.count() == Q.topic(spark, SF).where("partition = 1").count() > 0
    kept.unpersist()


@needs_tables
def test_messages_go_through_a_folder(spark, tmp_path):
    """Requests, vectors and notifications written as messages by a stream, and read back."""
    requests = Q.requests(spark, SF).withColumn("status", F.col("status").cast("int")).limit(300)
    log, out, cp = (str(tmp_path / n) for n in ("log", "out", "cp"))
    requests.write.parquet(log)
    stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    sinks.start_message_stream(E.messages(stream), cp, fmt="json", path=out, available_now=True).awaitTermination()
    sent = spark.read.json(out)
    assert sent.count() == 300 and set(json.loads(sent.first()["value"])) <= set(E.MESSAGE_FIELDS)

    values, heard = str(tmp_path / "values"), []
    sent.select("value").write.text(values)
    back = E.decode(E.event_stream(spark, "text", values))
    back.writeStream.foreachBatch(lambda b, _: heard.extend(b.select("endpoint", "client_id", "latency_ms", "malformed").collect())) \
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    want = sorted((r["path"], r["client_id"], float(r["latency_ms"])) for r in requests.collect())
    assert sorted((r["endpoint"], r["client_id"], r["latency_ms"]) for r in heard) == want and not any(r["malformed"] for r in heard)

    vectors = str(tmp_path / "vectors")
    ef.feature_vectors(requests.withColumn("endpoint", F.col("path"))).write.parquet(vectors)
    given = spark.read.parquet(vectors)
    as_stream = spark.readStream.schema(given.schema).parquet(vectors)
    sinks.start_message_stream(sinks.feature_messages(as_stream).drop("timestamp"), str(tmp_path / "cp3"), fmt="json", path=str(tmp_path / "features"),
                               available_now=True).awaitTermination()
    parsed, bad = sinks.parse_feature_messages(spark.read.json(str(tmp_path / "features")))
    assert bad.count() == 0
    assert sorted(map(tuple, parsed.collect())) == sorted(map(tuple, given.select(*parsed.columns).collect()))

    audit = str(tmp_path / "audit")
    lo, *_, hi = Q._edges(spark, SF)
    records, _ = control.scheduled_decisions(given, spark.range(lo, hi).withColumnRenamed("id", "cycle"), Q.predict)
    records.write.parquet(audit)
    decided = spark.readStream.schema(spark.read.parquet(audit).schema).parquet(audit)
    sinks.start_message_stream(sinks.notifications(decided), str(tmp_path / "cp4"), fmt="json", path=str(tmp_path / "told"), available_now=True).awaitTermination()
    told = spark.read.json(str(tmp_path / "told"))
    assert told.count() == spark.read.parquet(audit).where("action_type = 'DISPATCH'").count() > 0


@needs_tables
def test_stretches_of_the_topic_make_the_whole(spark):
    """Each round writes its own messages only, the broken ones included, and all rounds together all of them."""
    columns = ["partition", "offset", "key", "value", "timestamp"]
    whole = Q.topic(spark, SF).select(columns)
    middle = whole.agg(F.timestamp_millis(F.avg(F.unix_millis("timestamp")).cast("long"))).first()[0]
    early, later = Q.topic(spark, SF, lambda ts: ts <= F.lit(middle)), Q.topic(spark, SF, lambda ts: ts > F.lit(middle))
    assert early.where(F.col("timestamp") > F.lit(middle)).isEmpty() and later.where(F.col("timestamp") <= F.lit(middle)).isEmpty()
    both = early.unionByName(later).select(columns)
    assert both.count() == whole.count() and both.exceptAll(whole).isEmpty()
    assert early.where("partition = 1").count() > 0 and later.where("partition = 1").count() > 0


def test_usable_messages_are_not_kept_as_text(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(control, "materialise", lambda df: kept.append(df) or df)
    rows = [(1, '{"ts": 1704067200000, "endpoint": "/api/a", "latency_ms": 5}', T0), (2, '{"ts":', T0)]
    step = control.topic_batch(*[str(tmp_path / n) for n in ("vectors", "store", "state")], quarantine=str(tmp_path / "quarantine"))
    step(spark.createDataFrame(rows, "event_id long, value string, record_time timestamp"), 0)
    assert [r["value"] for r in kept[0].orderBy("event_id").collect()] == [None, '{"ts":']
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "quarantine")).collect()] == ['{"ts":']
    assert [r["event_id"] for r in control.read_store(spark, str(tmp_path / "store")).collect()] == [1]
