"""P-06..P-11, M-04..M-10, S-20, S-21, T-12: routes, validation, scoring, gate, policy, limiter."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import BASE_MS, r6, raw_events, request_events, table, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.stream_features import vector_sql
from pulsegrid.functions import web
from pulsegrid.functions.numeric import q6
from pulsegrid.operators import decisions as D
from pulsegrid.operators import limiter
from pulsegrid.operators import metrics as M
from pulsegrid.plans import event_features as ef
from pulsegrid.schema import AUDIT_COLS, FEATURE_COLS
from pulsegrid.session import scratch
from pulsegrid.sources import sinks

POLICY_SPEEDUP = 60
PRED_SQL = f"""pred AS (
  SELECT event_id, event_type AS service,
    epoch_ms({BASE_MS} + (epoch_us(ts) // 1000 - {BASE_MS}) // {POLICY_SPEEDUP}) AS timestamp, value * 20 AS main,
    value * 20 * 0.9 AS lower, value * 20 * 1.1 + event_id % 7 * 10 AS upper FROM events)"""
CONF = "greatest(0.0, least(1.0, 1.0 - (upper - lower) / greatest(main, 1.0)))"
GATED_SQL = f"""scored AS (SELECT *, {CONF} AS confidence FROM pred),
  gated AS (SELECT *, CASE WHEN main < 20 THEN 'HOLD' WHEN confidence >= 0.75 THEN 'DISPATCH' ELSE 'HOLD' END AS action_type,
    CASE WHEN main < 20 THEN 'prediction_too_low' WHEN confidence >= 0.75 THEN 'confidence_met'
         ELSE 'below_threshold' END AS reason FROM scored)"""


def predictions(spark, sf):
    """The events table as predictions per service, on a faster clock."""
    ev = raw_events(spark, sf)
    ts = F.timestamp_millis(F.lit(BASE_MS) + F.floor((F.unix_millis("ts") - BASE_MS) / F.lit(POLICY_SPEEDUP)))
    main = F.col("value") * 20
    return ev.select("event_id", F.col("event_type").alias("service"), ts.alias("timestamp"), main.alias("main"),
                     (main * 0.9).alias("lower"), (main * 1.1 + F.col("event_id") % 7 * 10).alias("upper"))


def gated(spark, sf):
    return D.gate(D.score(predictions(spark, sf)))


@query("p06_route_normalisation", """
  WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS path FROM pages),
  q AS (SELECT page_id, path FROM p UNION ALL SELECT page_id, '/api' || path FROM p
        UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/health' ELSE '/metrics' END FROM p)
  SELECT page_id, path, CASE WHEN path IN ('/health', '/metrics') THEN path WHEN path LIKE '/api/%' THEN '/api/*'
    ELSE '/other' END AS route FROM q""")
def p06(spark, sf):
    p = table(spark, sf, "pages").select("page_id", web.url_path(F.col("url")).alias("path"))
    q = p.unionByName(p.withColumn("path", F.concat(F.lit("/api"), "path"))).unionByName(
        p.withColumn("path", F.when(F.col("page_id") % 2 == 0, "/health").otherwise("/metrics")))
    return q.withColumn("route", web.normalise_route(F.col("path")))


@query("p07_client_default", """
  SELECT event_id, CASE WHEN event_type = 'view' THEN 'anonymous' WHEN event_type = 'error' THEN 'unknown'
    ELSE CAST(user_id AS VARCHAR) END AS client_id FROM events""")
def p07(spark, sf):
    ev = raw_events(spark, sf)
    claim = F.when(F.col("event_type") == "error", "").otherwise(F.col("user_id").cast("string"))
    return ev.select("event_id", web.client_or_default(claim, F.col("event_type") != "view").alias("client_id"))


def _damaged(spark, sf):
    """Feature vectors with gaps, NaN and infinities."""
    v = ef.feature_vectors(request_events(spark, sf, compress=True))
    rate = F.col("req_rate_1m")
    return v.withColumns({
        "latency_std_5m": F.when(F.col("latency_std_5m") < 10, F.lit(float("nan"))).otherwise(F.col("latency_std_5m")),
        "req_max_5m": F.when(F.col("req_max_5m") >= 4, F.lit(float("inf"))).otherwise(F.col("req_max_5m")),
        "ewma_03": F.when(rate > 0.5, F.lit(None)).otherwise(F.col("ewma_03")),
    })


@query("p08_feature_validation", f"""
  SELECT event_id, CASE WHEN latency_std_5m < 10 THEN 'latency_std_5m: NaN' WHEN req_max_5m >= 4 THEN 'req_max_5m: infinite'
    WHEN req_rate_1m > 0.5 THEN 'ewma_03: missing' END AS violation FROM ({vector_sql()})""")
def p08(spark, sf):
    return D.validate_features(_damaged(spark, sf)).select("event_id", "violation")


@query("p09_feature_array", f"""
  SELECT event_id, 26::BIGINT AS n, {r6(" + ".join(f"coalesce({c}, 0)" for c in FEATURE_COLS if c != "queue_depth"))} AS total,
    {r6('req_rate_1m')} AS ninth FROM ({vector_sql()})""")
def p09(spark, sf):
    v = ef.feature_vectors(request_events(spark, sf, compress=True))
    rounded = v.select("event_id", *[q6(F.col(c)).alias(c) for c in FEATURE_COLS if c != "queue_depth"])
    a = D.feature_array(rounded)
    return tidy(a.select(
        "event_id", F.size("features").cast("long").alias("n"),
        F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.element_at("features", 9).alias("ninth")))


@query("p10_threshold_bands", """
  SELECT event_id, CASE WHEN value >= 85 THEN 'green' WHEN value >= 70 THEN 'yellow' ELSE 'red' END AS cache_band,
    CASE WHEN value >= 50 THEN 'red' WHEN value >= 10 THEN 'yellow' ELSE 'green' END AS limit_band,
    CASE user_id % 3 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'ACTIVE' END AS status_name FROM events""")
def p10(spark, sf):
    ev = raw_events(spark, sf)
    return ev.select("event_id", M.band(F.col("value"), M.CACHE_BANDS).alias("cache_band"),
                     M.band(F.col("value"), M.LIMIT_BANDS).alias("limit_band"),
                     M.name_of(F.col("user_id") % 3, M.STATUS_NAMES).alias("status_name"))


@query("p11_status_filter", "SELECT event_id, 500::INTEGER AS status FROM events WHERE event_type = 'error'")
def p11(spark, sf):
    return request_events(spark, sf).filter(web.status_matches(F.col("status"), "5..")).select("event_id", "status")


@query("m04_scored_prediction", f"""WITH {PRED_SQL}
  SELECT event_id, {r6('main')} AS predicted_rate, {r6('lower')} AS lower_bound, {r6('upper')} AS upper_bound,
    {r6(CONF)} AS confidence, CASE WHEN {CONF} >= 0.75 THEN 'DISPATCH' ELSE 'HOLD' END AS action, {r6('0.75')} AS threshold_used
  FROM pred""")
def m04(spark, sf):
    return tidy(D.score(predictions(spark, sf)).drop("service", "timestamp", "main", "lower", "upper"))


@query("m05_confidence_gate", f"WITH {PRED_SQL}, {GATED_SQL} SELECT event_id, action_type, reason FROM gated")
def m05(spark, sf):
    return gated(spark, sf).select("event_id", "action_type", "reason")


_CYCLE = f"""cyc AS (SELECT service, epoch(timestamp)::BIGINT // 5 AS cycle, max((timestamp, event_id, main)) AS r
    FROM gated WHERE action_type = 'DISPATCH' GROUP BY ALL),
  seq AS (SELECT service, r[1] AS timestamp, r[3] AS rate, epoch_us(r[1]) // 1000000 AS s,
    row_number() OVER (PARTITION BY service ORDER BY r[1]) AS rn FROM cyc)"""
_CYCLE = _CYCLE.replace("epoch(timestamp)::BIGINT // 5", "epoch_us(timestamp) // 1000000 // 5").replace(
    "max((timestamp, event_id, main)) AS r", "arg_max(timestamp, (timestamp, event_id)) AS t, arg_max(main, (timestamp, event_id)) AS m"
).replace("r[1]", "t").replace("r[3]", "m")

_NEEDED = "least(greatest(CAST(ceil(q.rate / 500.0) AS BIGINT), 1), 6)"
_TARGET = f"least(p.cur + least({_NEEDED} - p.cur, 2), 6)"
_COOL = "p.acted IS NOT NULL AND q.s - p.acted < 60"
_OUT = f"q.rate > 500 AND {_TARGET} > p.cur"
_LOW = "q.rate < 200 AND p.cur > 1"
_IN = f"{_LOW} AND p.low IS NOT NULL AND q.s - p.low >= 120"
POLICY_SQL = f"""{_CYCLE},
  run AS (
    SELECT service, 0::BIGINT AS rn, NULL::TIMESTAMP AS timestamp, NULL::DOUBLE AS rate, 1::BIGINT AS cur, NULL::BIGINT AS acted,
      NULL::BIGINT AS low, NULL::BIGINT AS was, NULL::VARCHAR AS act, NULL::VARCHAR AS why FROM (SELECT DISTINCT service FROM seq)
    UNION ALL
    SELECT q.service, q.rn, q.timestamp, q.rate,
      CASE WHEN {_COOL} THEN p.cur WHEN {_OUT} THEN {_TARGET} WHEN q.rate > 500 THEN p.cur
           WHEN {_IN} THEN greatest(p.cur - 2, 1) ELSE p.cur END,
      CASE WHEN {_COOL} THEN p.acted WHEN {_OUT} THEN q.s WHEN q.rate > 500 THEN p.acted WHEN {_IN} THEN q.s ELSE p.acted END,
      CASE WHEN {_COOL} THEN p.low WHEN {_OUT} THEN NULL WHEN q.rate > 500 THEN p.low WHEN {_IN} THEN NULL
           WHEN {_LOW} THEN coalesce(p.low, q.s) ELSE NULL END,
      p.cur,
      CASE WHEN {_COOL} THEN 'COOLDOWN' WHEN {_OUT} THEN 'SCALE_OUT' WHEN q.rate > 500 THEN 'HOLD' WHEN {_IN} THEN 'SCALE_IN' ELSE 'HOLD' END,
      CASE WHEN {_COOL} THEN 'cooldown_active (' || (60 - (q.s - p.acted)) || 's remaining)'
           WHEN {_OUT} THEN 'predicted_rate=' || CAST(floor(q.rate + 0.5) AS BIGINT) || ' > threshold=500'
           WHEN q.rate > 500 THEN 'at_max_replicas (6)'
           WHEN {_IN} THEN 'predicted_rate=' || CAST(floor(q.rate + 0.5) AS BIGINT) || ' < threshold=200 for ' || (q.s - p.low) || 's'
           WHEN {_LOW} AND p.low IS NULL THEN 'scale_in_delay_started'
           WHEN {_LOW} THEN 'scale_in_pending (' || (120 - (q.s - p.low)) || 's remaining)'
           ELSE 'within_thresholds' END
    FROM run p JOIN seq q ON q.service = p.service AND q.rn = p.rn + 1)"""


def policy(spark, sf):
    """The newest row of a cycle is what is gated; the policy sees those that pass."""
    cycles = D.newest_per_cycle(gated(spark, sf).select("service", "timestamp", "event_id", "predicted_rate", "action_type"), tie=["event_id"])
    return D.scaling_policy(cycles.filter(F.col("action_type") == "DISPATCH").drop("action_type"))


_ACYCLE = """ac AS (SELECT service, epoch_us(timestamp) // 1000000 // 5 AS cycle, arg_max(event_id, (timestamp, event_id)) AS event_id
    FROM gated GROUP BY ALL),
  ag AS (SELECT gated.* FROM gated JOIN ac USING (event_id)),
  seq AS (SELECT service, timestamp, main AS rate, epoch_us(timestamp) // 1000000 AS s,
    row_number() OVER (PARTITION BY service ORDER BY timestamp) AS rn FROM ag WHERE action_type = 'DISPATCH')"""


@query("m06_scaling_policy", f"""WITH RECURSIVE {PRED_SQL}, {GATED_SQL}, {POLICY_SQL.replace(_CYCLE, _ACYCLE)}
  SELECT service, timestamp, {r6('rate')} AS predicted_rate, act AS scale_action, was::INTEGER AS current_replicas,
    cur::INTEGER AS target_replicas, why AS scale_reason FROM run WHERE rn > 0""")
def m06(spark, sf):
    return tidy(policy(spark, sf).drop(*D.STATE_COLS))


def audit(spark, sf):
    g = gated(spark, sf)
    cycles = D.newest_per_cycle(g.drop("main", "lower", "upper"), tie=["event_id"])
    sent = cycles.filter(F.col("action_type") == "DISPATCH")
    return D.decision_records(cycles, D.scaling_policy(sent))


AUDIT_SQL = f"""{PRED_SQL}, {GATED_SQL}, {POLICY_SQL.replace(_CYCLE, _ACYCLE)},
  audit AS (SELECT ag.timestamp, ag.service, action_type, confidence, main AS predicted_rate, reason, 0::BIGINT AS duration_ms,
    CASE WHEN action_type = 'DISPATCH' THEN cur ELSE 0 END::INTEGER AS desired_replicas,
    CASE WHEN action_type = 'DISPATCH' THEN cur ELSE 0 END::INTEGER AS actual_replicas,
    0::BIGINT AS provisioning_latency_ms, CASE WHEN action_type = 'DISPATCH' THEN 'local' END AS scaler_mode,
    CASE WHEN action_type = 'DISPATCH' THEN act ELSE 'HOLD' END AS scale_action
    FROM ag LEFT JOIN run ON run.service = ag.service AND run.timestamp = ag.timestamp AND run.rn > 0)"""
_AUDIT_SELECT = ", ".join(f"{r6(c)} AS {c}" if c in ("confidence", "predicted_rate") else c for c in AUDIT_COLS)


@query("m07_decision_records", f"WITH RECURSIVE {AUDIT_SQL} SELECT {_AUDIT_SELECT} FROM audit")
def m07(spark, sf):
    return tidy(audit(spark, sf))


@query("s20_audit_sink", f"WITH RECURSIVE {AUDIT_SQL} SELECT {_AUDIT_SELECT} FROM audit")
def s20(spark, sf):
    path = scratch(spark, "audit")
    sinks.append_audit(audit(spark, sf), path)
    return tidy(spark.read.parquet(path).drop("day"))


@query("s21_notifications", f"""WITH RECURSIVE {AUDIT_SQL}
  SELECT service AS key, scale_action AS action, {r6('predicted_rate')} AS predicted_rate, desired_replicas,
    epoch_us(timestamp) // 1000 AS ts FROM audit WHERE action_type = 'DISPATCH'""")
def s21(spark, sf):
    sent = sinks.notifications(audit(spark, sf))
    v = F.from_json("value", "action string, predicted_rate double, desired_replicas int, timestamp bigint")
    return tidy(sent.withColumn("_v", v).select(
        "key", "_v.action", "_v.predicted_rate", "_v.desired_replicas", F.col("_v.timestamp").alias("ts")))


@query("m08_anomaly_band", """
  SELECT event_id, CASE WHEN -value / 200 > -0.1 THEN 'anomaly' WHEN -value / 200 > -0.2 THEN 'suspicious' ELSE 'normal' END AS band
  FROM events""")
def m08(spark, sf):
    return raw_events(spark, sf).select("event_id", D.anomaly_band(-F.col("value") / 200).alias("band"))


@query("m10_heuristics", f"""
  SELECT event_id, {r6('req_rate_1m * 1.2')} AS predicted_load,
    CASE WHEN req_rate_1m * 1.2 > 100 THEN 'SCALE_UP' ELSE 'MAINTAIN' END AS heuristic_action,
    {r6('abs(rate_of_change) * 10')} AS anomaly_score, abs(rate_of_change) * 10 > 50 AS is_anomaly
  FROM (SELECT event_id, value AS req_rate_1m, (value - 20) / 3 AS rate_of_change FROM events)""")
def m10(spark, sf):
    ev = raw_events(spark, sf).select(
        "event_id", F.col("value").alias("req_rate_1m"), ((F.col("value") - 20) / 3).alias("rate_of_change"))
    return tidy(D.heuristics(ev).drop("req_rate_1m", "rate_of_change"))


LIMIT_SPEEDUP, LIMIT_TEST = 6000, 3
REQ_SQL = f"""req AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS client_id, {BASE_MS} + (epoch_us(ts) // 1000 - {BASE_MS}) // {LIMIT_SPEEDUP} AS ms,
    CASE WHEN event_type = 'signup' THEN '/health' ELSE '/api/' || event_type END AS path FROM events)"""
LIMITED_SQL = f"""{REQ_SQL},
  g AS (SELECT * FROM req WHERE path <> '/health'),
  a AS (SELECT client_id, min(ms) AS anchor FROM g GROUP BY 1
    UNION ALL
    SELECT g.client_id, min(g.ms) FROM a JOIN g ON g.client_id = a.client_id AND g.ms >= a.anchor + 60000 GROUP BY g.client_id),
  w AS (SELECT g.*, (SELECT max(anchor) FROM a WHERE a.client_id = g.client_id AND a.anchor <= g.ms) AS anchor FROM g),
  lim AS (SELECT event_id, client_id, ms, path, row_number() OVER (PARTITION BY client_id, anchor ORDER BY ms, event_id) AS window_count FROM w
    UNION ALL SELECT event_id, client_id, ms, path, NULL FROM req WHERE path = '/health')"""


def requests(spark, sf):
    ev = raw_events(spark, sf)
    ms = F.lit(BASE_MS) + F.floor((F.unix_millis("ts") - BASE_MS) / F.lit(LIMIT_SPEEDUP))
    path = F.when(F.col("event_type") == "signup", "/health").otherwise(F.concat(F.lit("/api/"), "event_type"))
    return ev.select("event_id", F.timestamp_millis(ms).alias("ts"), F.col("user_id").cast("string").alias("client_id"),
                     path.alias("path"))


@query("t12_rate_limiter", f"""WITH RECURSIVE {LIMITED_SQL}
  SELECT event_id, client_id, coalesce(window_count, 0)::BIGINT AS window_count, coalesce(window_count <= {LIMIT_TEST}, true) AS allowed FROM lim""")
def t12(spark, sf):
    out = limiter.rate_limit(requests(spark, sf), limit=LIMIT_TEST)
    return out.select("event_id", "client_id", F.coalesce("window_count", F.lit(0).cast("long")).alias("window_count"), "allowed")


@query("a15_limited_hits", f"""WITH RECURSIVE {LIMITED_SQL}
  SELECT epoch_ms(ms // 300000 * 300000) AS window_start, client_id, count(*) AS hits FROM lim
  WHERE window_count > {LIMIT_TEST} GROUP BY ALL""")
def a15(spark, sf):
    return tidy(M.limited_hits(limiter.rate_limit(requests(spark, sf), limit=LIMIT_TEST)))
