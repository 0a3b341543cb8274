"""T-09..T-15 as Structured Streaming jobs run to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.decision_queries import AUDIT_SQL, LIMIT_TEST, LIMITED_SQL, POLICY_SPEEDUP, _AUDIT_SELECT
from pulsegrid.catalog.inputs import BASE_MS, EVC_SQL, SPEEDUP, r6, tidy
from pulsegrid.catalog.metric_queries import HIST_SQL, _quantile_sql
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.stream_features import vector_sql
from pulsegrid.session import scratch, use_utc
from pulsegrid.sources.sinks import latest_per_key
from pulsegrid.streaming import features, limiter, metrics, scoring, store

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf, speedup: int = 1):
    """The events table as a stream of request events."""
    raw = use_utc(spark).readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ts = F.timestamp_millis(F.lit(BASE_MS) + F.floor((ms - BASE_MS) / F.lit(speedup)))
    return raw.select(
        "event_id", ts.alias("ts"), F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"),
        F.col("user_id").cast("string").alias("client_id"), F.lit("GET").alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def _run(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("t09b_feature_stream", vector_sql())
def t09b(spark, sf):
    out, state, cp = (scratch(spark, n) for n in ("vectors", "state", "cp"))
    _run(features.start_feature_stream(event_stream(spark, sf, SPEEDUP), out, state, cp, available_now=True))
    return tidy(features.read_vectors(spark, out))


@query("t10_state_retention", f"""WITH {EVC_SQL}, s AS (
    SELECT endpoint, sec, count(*) AS cnt, arg_max(latency_ms, (ms, event_id)) AS last_latency FROM ev GROUP BY ALL),
  t AS (SELECT *, max(sec) OVER (PARTITION BY endpoint) AS top FROM s)
  SELECT endpoint, sec, cnt, {r6('CASE WHEN sec >= top - 900 THEN last_latency END')} AS last_latency
  FROM t WHERE sec >= top - 1800""")
def t10(spark, sf):
    out, state, cp = (scratch(spark, n) for n in ("vectors", "state", "cp"))
    _run(features.start_feature_stream(event_stream(spark, sf, SPEEDUP), out, state, cp, available_now=True))
    return tidy(spark.read.parquet(f"{state}/seconds/slot=0"))


@query("t11_late_events", f"""WITH {EVC_SQL}, top AS (SELECT max(sec) AS top FROM ev)
  SELECT event_id, endpoint, sec < top - 1800 AS is_late FROM ev, top""")
def t11(spark, sf):
    """The whole table arrives twice; the second time everything behind the watermark is set aside."""
    out, state, late = (scratch(spark, n) for n in ("vectors", "state", "late"))
    step = features.feature_batch(out, state, late=late)
    for batch_id in (0, 1):
        single = event_stream(spark, sf, SPEEDUP).writeStream.foreachBatch(lambda b, _, i=batch_id: step(b, i))
        _run(single.option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start())
    aside = spark.read.parquet(late).select("event_id", "endpoint", F.lit(True).alias("is_late"))
    again = spark.read.parquet(f"{out}/batch_id=1").select("event_id", "endpoint", F.lit(False).alias("is_late"))
    return aside.unionByName(again)


@query("t12b_rate_limit_stream", f"""WITH RECURSIVE {LIMITED_SQL}
  SELECT event_id, client_id, coalesce(window_count, 0)::BIGINT AS window_count, coalesce(window_count <= {LIMIT_TEST}, true) AS allowed
  FROM lim""")
def t12b(spark, sf):
    ev = event_stream(spark, sf, 6000)
    path = F.when(F.col("endpoint") == "signup", "/health").otherwise(F.concat(F.lit("/api/"), "endpoint"))
    out, state, cp = (scratch(spark, n) for n in ("decisions", "windows", "cp"))
    _run(limiter.start_limit_stream(ev.withColumn("path", path), out, state, cp, limit=LIMIT_TEST, available_now=True))
    return limiter.read_decisions(spark, out).select(
        "event_id", "client_id", F.coalesce("window_count", F.lit(0).cast("long")).alias("window_count"), "allowed")


@query("t13_minute_metrics_stream", f"""WITH {EVC_SQL}, {HIST_SQL.replace('count(*) AS le_inf', "count(*) AS le_inf, count(*) FILTER (status >= 500) AS errors")}
  SELECT window_start, endpoint, le_inf AS requests, errors, {r6('le_inf / 60.0')} AS rate, {r6('errors / 60.0')} AS error_rate,
    {r6('errors / le_inf::DOUBLE')} AS error_ratio, {r6(_quantile_sql(0.95))} AS latency_ms FROM hist""")
def t13(spark, sf):
    ev = event_stream(spark, sf, SPEEDUP).withColumn("latency_ms", F.col("latency_ms") * 7)
    out, cp = scratch(spark, "metrics"), scratch(spark, "cp")
    _run(store.start_keyed_update_stream(metrics.minute_metrics(ev), out, cp, available_now=True))
    newest = latest_per_key(spark.read.parquet(out), ["window_start", "endpoint"], "batch_id").drop("batch_id")
    return tidy(metrics.with_rates(newest))


SLIDING = 300_000  # length of the sliding windows
_SLIDING_HIST = HIST_SQL[HIST_SQL.index("count(*) FILTER"):].split(" FROM ev")[0]


def _sliding_sql(rows: str, key: str, counts: str, delay: int) -> str:
    """Windows begun every minute that the watermark, ``delay`` behind the newest row, has passed."""
    return f"""copied AS (SELECT *, unnest(range(ms // 60000 - 4, ms // 60000 + 1)) * 60000 AS b FROM {rows}),
  hist AS (SELECT epoch_ms(b) AS window_start, {key}, {counts} FROM copied
    WHERE b + {SLIDING} <= (SELECT max(ms) - {delay} FROM {rows}) GROUP BY ALL)"""


@query("t13b_sliding_metrics_stream", f"""WITH {EVC_SQL}, {_sliding_sql("ev", "endpoint", _SLIDING_HIST + ", count(*) FILTER (status >= 500) AS errors", 600_000)}
  SELECT window_start, endpoint, le_inf AS requests, errors, {r6('le_inf / 300.0')} AS rate, {r6('errors / 300.0')} AS error_rate,
    {r6('errors / le_inf::DOUBLE')} AS error_ratio, {r6(_quantile_sql(0.95))} AS latency_ms FROM hist""")
def t13b(spark, sf):
    """Increase, rates and quantile of the last five minutes, every minute: two stateful steps in one stream."""
    ev = event_stream(spark, sf, SPEEDUP).withColumn("latency_ms", F.col("latency_ms") * 7)
    out, cp = scratch(spark, "sliding"), scratch(spark, "cp")
    _run(metrics.start_append_stream(metrics.sliding_metrics(ev), out, cp, available_now=True))
    return tidy(metrics.with_rates(spark.read.parquet(out), 300.0))


@query("t13c_limited_hits_stream", f"""WITH RECURSIVE {LIMITED_SQL}, over AS (SELECT * FROM lim WHERE window_count > {LIMIT_TEST}),
  {_sliding_sql("over", "client_id", "count(*) AS hits", 30_000)} SELECT * FROM hist""")
def t13c(spark, sf):
    """The limiter's stream and, behind it, the stream that counts what it rejected."""
    ev = event_stream(spark, sf, 6000)
    path = F.when(F.col("endpoint") == "signup", "/health").otherwise(F.concat(F.lit("/api/"), "endpoint"))
    decided, state, out = (scratch(spark, n) for n in ("decisions", "windows", "hits"))
    _run(limiter.start_limit_stream(ev.withColumn("path", path), decided, state, scratch(spark, "cp"), limit=LIMIT_TEST, available_now=True))
    decisions = spark.readStream.schema(spark.read.parquet(decided).schema).parquet(decided)
    _run(metrics.start_append_stream(metrics.limited_hits_stream(decisions, watermark="30 seconds"), out, scratch(spark, "cp"), available_now=True))
    return tidy(spark.read.parquet(out))


@query("t14_store_upsert_stream", f"""
  SELECT event_type AS endpoint, date_trunc('hour', ts) AS timestamp, {r6('arg_max(value, event_id)')} AS value FROM events GROUP BY 1, 2""")
def t14(spark, sf):
    points = event_stream(spark, sf).select(
        "endpoint", F.date_trunc("hour", "ts").alias("timestamp"), F.col("event_id").alias("arrival"),
        F.col("latency_ms").alias("value"))
    out, cp = scratch(spark, "points"), scratch(spark, "cp")
    _run(store.start_upsert_stream(points, out, cp, arrival="arrival", available_now=True))
    return tidy(spark.read.parquet(out).select("endpoint", "timestamp", "value"))


def _given_bounds(df):
    """Stand-in for a model: rate and bounds computed from the event's value."""
    main = F.col("latency_ms") * 20
    return df.withColumns({"main": main, "lower": main * 0.9, "upper": main * 1.1 + F.col("event_id") % 7 * 10})


@query("t15_periodic_scoring", f"WITH RECURSIVE {AUDIT_SQL} SELECT {_AUDIT_SELECT} FROM audit")
def t15(spark, sf):
    vectors = event_stream(spark, sf, POLICY_SPEEDUP).select(
        F.col("endpoint").alias("service"), F.col("ts").alias("timestamp"), "event_id", "latency_ms")
    out, state, cp = (scratch(spark, n) for n in ("audit", "state", "cp"))
    _run(scoring.start_scoring_stream(vectors, _given_bounds, out, state, cp, available_now=True, tie=["event_id"]))
    return tidy(spark.read.parquet(out).drop("batch_id"))
