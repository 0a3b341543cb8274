"""A-11..A-21, J-02, K-01..05, Q-01..07, S-19: dashboards, newest records, quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.decision_queries import AUDIT_SQL, _AUDIT_SELECT, audit
from pulsegrid.catalog.inputs import EV_SQL, EVC_SQL, r6, raw_events, request_events, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.rolling_queries import SER, minutes
from pulsegrid.catalog.series_queries import event_series
from pulsegrid.catalog.source_queries import _INGEST, manifest_for
from pulsegrid.catalog.stream_features import vector_sql
from pulsegrid.operators import latest as K
from pulsegrid.operators import metrics as M
from pulsegrid.operators import quality as Q
from pulsegrid.operators import series as S
from pulsegrid.plans import event_features as ef
from pulsegrid.plans.training import build_features
from pulsegrid.schema import FEATURE_COLS
from pulsegrid.session import materialise, scratch
from pulsegrid.sources.manifest import contributions, ingest
from pulsegrid.sources.sinks import write_report

MIN = "time_bucket(INTERVAL 1 MINUTE, ts)"
BY = ["method", "endpoint", "status"]


@query("a11_request_rates", f"""WITH {EV_SQL} SELECT {MIN} AS window_start, method, endpoint, status, count(*) AS increase,
  {r6('count(*) / 60.0')} AS rate FROM ev GROUP BY ALL""")
def a11(spark, sf):
    return tidy(M.request_rates(request_events(spark, sf), BY))


@query("a11b_request_totals", f"WITH {EV_SQL} SELECT method, endpoint, status, count(*) AS total FROM ev GROUP BY ALL")
def a11b(spark, sf):
    return M.totals(request_events(spark, sf), BY)


_LE = ", ".join(f"count(*) FILTER (latency_ms / 10.0 / 1000.0 <= {b}) AS {n}" for b, n in zip(M.LATENCY_BOUNDS, M.LE_NAMES))
HIST_SQL = f"""hist AS (SELECT endpoint, {MIN} AS window_start, {_LE.replace(' / 10.0', ' * 7')}, count(*) AS le_inf FROM ev GROUP BY ALL)"""


@query("a12_latency_histogram", f"WITH {EV_SQL}, {HIST_SQL} SELECT * FROM hist")
def a12(spark, sf):
    ev = request_events(spark, sf)
    return tidy(M.latency_histogram(ev, [M.bucket().alias("window_start"), "endpoint"], F.col("latency_ms") * 7 / 1000.0))


def _quantile_sql(q: float) -> str:
    cases, lower, prev = [], "0.0", "0"
    for b, n in zip(M.LATENCY_BOUNDS, M.LE_NAMES):
        cases.append(f"WHEN {n} >= {q} * le_inf THEN {lower}::DOUBLE + ({b}::DOUBLE - {lower}) * ({q} * le_inf - {prev}) / ({n} - {prev})")
        lower, prev = str(b), n
    return f"(CASE {' '.join(cases)} ELSE {M.LATENCY_BOUNDS[-1]} END) * 1000"


@query("a13_histogram_quantile",
       f"WITH {EVC_SQL}, {HIST_SQL} SELECT window_start, endpoint, {r6(_quantile_sql(0.95))} AS latency_ms FROM hist")
def a13(spark, sf):
    ev = request_events(spark, sf, compress=True).withColumn("latency_ms", F.col("latency_ms") * 7)
    return tidy(M.latency_quantile_ms(ev, ["endpoint"]))


@query("a13b_exact_quantile", f"""WITH {EVC_SQL} SELECT {MIN} AS window_start, endpoint,
  {r6('quantile_cont(latency_ms, 0.95)')} AS latency_ms FROM ev GROUP BY ALL""")
def a13b(spark, sf):
    return tidy(M.exact_latency_quantile(request_events(spark, sf, compress=True), ["endpoint"]))


@query("a14_error_rates", f"""WITH {EVC_SQL} SELECT {MIN} AS window_start, {r6('count(*) FILTER (status >= 500) / 60.0')} AS error_rate,
  {r6('count(*) FILTER (status >= 500) / count(*)::DOUBLE')} AS error_ratio FROM ev GROUP BY ALL""")
def a14(spark, sf):
    return tidy(M.error_rates(request_events(spark, sf, compress=True)))


@query("j02_label_matched_ratio", f"""WITH {EVC_SQL} SELECT {MIN} AS window_start, client_id,
  {r6('count(*) FILTER (status >= 500) / 60.0')} AS error_rate,
  {r6('count(*) FILTER (status >= 500) / count(*)::DOUBLE')} AS error_ratio FROM ev GROUP BY ALL""")
def j02(spark, sf):
    return tidy(M.error_rates(request_events(spark, sf, compress=True), ["client_id"]))


@query("a16_action_counts", f"""WITH RECURSIVE {AUDIT_SQL}
  SELECT action_type, scale_action, count(*) AS actions FROM audit GROUP BY ALL""")
def a16(spark, sf):
    return M.action_counts(audit(spark, sf))


@query("a17_provisioning_stats", """
  SELECT sum(v)::BIGINT // count(*) AS avg_ms, min(v) AS min_ms, max(v) AS max_ms, count(*) AS samples
  FROM (SELECT CAST(floor(value) AS BIGINT) AS v FROM events) WHERE v > 0""")
def a17(spark, sf):
    ev = raw_events(spark, sf).select(F.floor("value").cast("long").alias("provisioning_latency_ms"))
    return M.provisioning_stats(ev)


@query("a18_phase_summary", f"""WITH {EV_SQL}, p AS (SELECT *, CASE WHEN day(ts) <= 5 THEN 1 WHEN day(ts) <= 12 THEN 2 WHEN day(ts) <= 20 THEN 3 ELSE 4 END AS phase,
    CAST(event_id % 6 + 1 AS INTEGER) AS replicas FROM ev)
  SELECT phase::INTEGER AS phase, {r6('quantile_cont(latency_ms, 0.5)')} AS p50, {r6('quantile_cont(latency_ms, 0.95)')} AS p95,
    count(*) FILTER (status >= 500) AS errors, arg_min(replicas, ts) AS start_replicas, arg_max(replicas, ts) AS end_replicas
  FROM p GROUP BY phase""")
def a18(spark, sf):
    d = F.dayofmonth("ts")
    ev = request_events(spark, sf).withColumn("phase", F.when(d <= 5, 1).when(d <= 12, 2).when(d <= 20, 3).otherwise(4)) \
        .withColumn("replicas", (F.col("event_id") % 6 + 1).cast("int"))
    return tidy(M.phase_summary(ev))


@query("a19_replica_status", """
  SELECT CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS service, count(*) AS total,
    count(*) FILTER (value >= 10) AS running
  FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def a19(spark, sf):
    ev = raw_events(spark, sf)
    state = F.when(F.col("value") >= 10, "Running").otherwise("exited")
    line = (
        F.when(F.col("event_type") == "error", F.lit("{broken"))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(state.alias("State"))))
        .otherwise(F.to_json(F.struct(F.col("event_type").alias("Service"), state.alias("State")))))
    return M.replica_status(ev.select(line.alias("value")))


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count({c}) AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
    {r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}, 0.25)')} AS p25, {r6(f'quantile_cont({c}, 0.5)')} AS p50,
    {r6(f'quantile_cont({c}, 0.75)')} AS p75, {r6(f'max({c})')} AS max FROM f""" for n, c in
    (("req_rate_1m", "r"), ("future_req_rate_5m", "fut"), ("is_surge", "surge")))


@query("a20_summary_statistics", f"""WITH {SER},
  f AS (SELECT r, coalesce(lead(r, 5) OVER (ORDER BY idx), (SELECT arg_max(r, timestamp) FROM m)) AS fut,
    CASE WHEN r > greatest(1, 3 * (SELECT median(r) FROM m)) THEN 1.0::DOUBLE ELSE 0.0 END AS surge FROM m) {_DESCRIBE}""")
def a20(spark, sf):
    return tidy(M.describe(materialise(build_features(minutes(spark, sf))), ["req_rate_1m", "future_req_rate_5m", "is_surge"]))


@query("a21_gauge_timeline", f"""WITH RECURSIVE {AUDIT_SQL},
  last AS (SELECT service, time_bucket(INTERVAL 1 MINUTE, timestamp) AS bin, arg_max(desired_replicas, timestamp) AS desired_replicas,
     arg_max(greatest(actual_replicas, 0), timestamp) AS actual_replicas, arg_max(confidence, timestamp) AS confidence FROM audit GROUP BY ALL),
  grid AS (SELECT service, unnest(generate_series(min(bin), max(bin), INTERVAL 1 MINUTE)) AS bin FROM last GROUP BY service)
  SELECT service, bin AS timestamp, {", ".join(f"{r6(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY service ORDER BY bin)')} AS {c}" for c in ("desired_replicas", "actual_replicas", "confidence"))}
  FROM grid LEFT JOIN last USING (service, bin)""")
def a21(spark, sf):
    a = audit(spark, sf).withColumn("actual_replicas", F.greatest("actual_replicas", F.lit(0)))
    return tidy(M.gauge_timeline(a, ["desired_replicas", "actual_replicas", "confidence"], keys=["service"]))


@query("k01_latest_actions", f"WITH RECURSIVE {AUDIT_SQL} SELECT {_AUDIT_SELECT} FROM audit ORDER BY timestamp DESC, service LIMIT 50")
def k01(spark, sf):
    return tidy(K.latest_actions(audit(spark, sf), 50))


@query("k02_latest_status", f"WITH RECURSIVE {AUDIT_SQL} SELECT {_AUDIT_SELECT} FROM audit ORDER BY timestamp DESC, service DESC LIMIT 1")
def k02(spark, sf):
    return tidy(K.latest_status(audit(spark, sf)))


@query("k03_latest_vector", f"""WITH v AS ({vector_sql()}),
  r AS (SELECT * FROM v WHERE timestamp > (SELECT max(timestamp) FROM v) - INTERVAL 3 MINUTE)
  SELECT endpoint, {", ".join(f"{r6(f'arg_max({c}, (timestamp, event_id))')} AS {c}" for c in FEATURE_COLS)} FROM r GROUP BY endpoint""")
def k03(spark, sf):
    v = ef.feature_vectors(request_events(spark, sf, compress=True))
    # one point per (endpoint, timestamp), as the store would hold, then the narrow form
    points = v.groupBy("endpoint", "timestamp").agg(F.max_by(F.struct(*FEATURE_COLS), "event_id").alias("_p")) \
        .select("endpoint", "timestamp", "_p.*")
    return tidy(K.latest_vector(points.unpivot(["endpoint", "timestamp"], FEATURE_COLS, "field", "value")))


@query("k04_latest_field_percent", f"""WITH {EVC_SQL}
  SELECT endpoint, {r6('arg_max(latency_ms / 200.0, (ts, event_id)) * 100')} AS percent FROM ev
  WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 5 MINUTE GROUP BY endpoint""")
def k04(spark, sf):
    ev = request_events(spark, sf, compress=True).withColumn("cache_hit_ratio", F.col("latency_ms") / 200.0)
    return tidy(K.latest_field_percent(ev, "cache_hit_ratio", ts="ts", tie=["event_id"]))


_GAPS = f"""g AS (SELECT after, before, (epoch_us(before) - epoch_us(after)) / 1e6 AS gap_seconds FROM (
    SELECT ts AS before, lag(ts) OVER (ORDER BY ts) AS after FROM events)
  WHERE epoch_us(before) - epoch_us(after) > 2 * 300 * 1000000::BIGINT)"""


def _raw_series(spark, sf):
    return event_series(spark, sf).drop("source")


@query("k05_first_gaps", f"WITH {_GAPS} SELECT after, before, {r6('gap_seconds')} AS gap_seconds FROM g ORDER BY before LIMIT 20")
def k05(spark, sf):
    return tidy(Q.first_gaps(S.gaps(_raw_series(spark, sf), "5min")))


@query("k05b_last_actions", f"WITH RECURSIVE {AUDIT_SQL} SELECT {_AUDIT_SELECT} FROM audit ORDER BY timestamp DESC, service LIMIT 5")
def k05b(spark, sf):
    return tidy(K.latest_actions(audit(spark, sf), 5))


@query("q01_shape", "SELECT count(*) AS total_rows, 6::BIGINT AS total_columns FROM events")
def q01(spark, sf):
    return Q.shape(raw_events(spark, sf))


@query("q02_date_range", f"""SELECT min(ts) AS "start", max(ts) AS "end", {r6('round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 2)')} AS span_days FROM events""")
def q02(spark, sf):
    return tidy(Q.date_range(raw_events(spark, sf), "ts"))


@query("q03_duplicate_timestamps", "SELECT count(*) - count(DISTINCT o_orderdate) AS duplicate_timestamps FROM orders")
def q03(spark, sf):
    from pulsegrid.catalog.inputs import table

    return Q.duplicates(table(spark, sf, "orders"), "o_orderdate")


@query("q04_source_shares", f"""WITH {_INGEST}, c AS (SELECT source, count(*) AS rows FROM tagged GROUP BY 1)
  SELECT source, rows, {r6('round(100.0 * rows / (SELECT sum(rows) FROM c), 2)')} AS percent FROM c""")
def q04(spark, sf):
    return tidy(Q.source_shares(contributions(ingest(spark, manifest_for(spark, sf)))))


@query("q05_null_counts", """
  SELECT 'value' AS "column", count(*) AS nulls FROM events WHERE value < 5
  UNION ALL SELECT 'event_type', count(*) FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'ratio', count(*) FROM events WHERE value > 50""")
def q05(spark, sf):
    ev = raw_events(spark, sf)
    holes = ev.select(
        "event_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"),
        F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value")).alias("ratio"))
    return Q.null_counts(holes)


@query("q06_gap_summary", f"""WITH {_GAPS} SELECT count(*) AS total_gaps,
  {r6('coalesce(round(max(gap_seconds), 1), 0)')} AS max_gap_seconds FROM g""")
def q06(spark, sf):
    return tidy(Q.gap_summary(S.gaps(_raw_series(spark, sf), "5min")))


_OUTLIER = f"""z AS (SELECT r, quantile_cont(r, 0.5) OVER f AS med, coalesce(stddev_samp(r) OVER f, 1) AS sd FROM m
    WINDOW f AS (ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
  o AS (SELECT round(count(*) FILTER (abs((r - med) / greatest(sd, 1e-6)) > 3) / count(*)::DOUBLE, 6) AS outlier_ratio FROM z)"""


@query("q07_outlier_ratio", f"WITH {SER}, {_OUTLIER} SELECT {r6('outlier_ratio')} AS outlier_ratio FROM o")
def q07(spark, sf):
    return tidy(Q.series_outlier_ratio(minutes(spark, sf)))


@query("s19_quality_report", f"""WITH {SER}, {_OUTLIER}
  SELECT count(*) AS total_rows, 2::BIGINT AS total_columns, strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S.000Z') AS "start",
    {r6('round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6, 2)')} AS span_days, 0::BIGINT AS total_gaps,
    {r6('0')} AS max_gap_seconds, 0::BIGINT AS duplicate_timestamps, {r6('(SELECT outlier_ratio FROM o)')} AS outlier_ratio,
    count(*) AS source_rows, {r6('100')} AS percent, true AS null_free FROM m""")
def s19(spark, sf):
    series = materialise(minutes(spark, sf))
    source = series.select(F.lit("traffic").alias("source"))
    path = scratch(spark, "report")
    write_report(Q.report(series.drop("idx"), contributions(source)), path)
    r = spark.read.json(path)
    only = F.col("source_contributions")[0]
    return tidy(r.select(
        "total_rows", "total_columns", F.col("date_range.start").alias("start"), "date_range.span_days",
        "timestamp_continuity.total_gaps", "timestamp_continuity.max_gap_seconds", "duplicate_timestamps",
        "outlier_ratio", only["rows"].alias("source_rows"), only["percent"].alias("percent"), "null_free"))


@query("s19b_report_of_orders", f"""WITH m AS (SELECT o_orderdate AS timestamp, o_orderstatus AS source, CASE WHEN o_totalprice >= 20000 THEN o_totalprice END AS r,
    row_number() OVER (ORDER BY o_orderdate, CASE WHEN o_totalprice >= 20000 THEN o_totalprice END NULLS FIRST) AS idx FROM orders), {_OUTLIER},
  g AS (SELECT before, after, epoch(before) - epoch(after) AS s FROM (SELECT timestamp AS before, lag(timestamp) OVER (ORDER BY timestamp) AS after FROM m)
    WHERE epoch(before) - epoch(after) > 86400),
  listed AS (SELECT *, row_number() OVER (ORDER BY before) AS k FROM g)
  SELECT source, count(*) AS source_rows, {r6('round(100.0 * count(*) / (SELECT count(*) FROM m), 2)')} AS percent,
    (SELECT count(*) FROM m) AS total_rows, 2::BIGINT AS total_columns,
    (SELECT {r6('round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6, 2)')} FROM m) AS span_days,
    (SELECT count(*) FROM g) AS total_gaps, (SELECT {r6('coalesce(round(max(s), 1), 0)')} FROM g) AS max_gap_seconds,
    (SELECT {r6('coalesce(sum(s), 0)')} FROM listed WHERE k <= 20) AS listed_seconds,
    (SELECT count(*) - count(DISTINCT timestamp) FROM m) AS duplicate_timestamps, (SELECT {r6('outlier_ratio')} FROM o) AS outlier_ratio,
    (SELECT count(*) FROM m WHERE r IS NULL) AS null_values FROM m GROUP BY source""")
def s19b(spark, sf):
    from pulsegrid.catalog.inputs import table

    price = F.col("o_totalprice").cast("double")
    series = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.when(price >= 20000, price).alias("value"),
                                               F.col("o_orderstatus").alias("source"))
    r = Q.report(series.drop("source"), contributions(series.select("source")), interval="12h")
    found = F.filter("null_counts", lambda c: c["column"] == "value")
    listed = F.aggregate("timestamp_continuity.gaps", F.lit(0.0), lambda total, g: total + g["gap_seconds"])
    return tidy(r.select(
        F.explode("source_contributions").alias("c"), "total_rows", "total_columns", "date_range.span_days", "timestamp_continuity.total_gaps",
        "timestamp_continuity.max_gap_seconds", listed.alias("listed_seconds"), "duplicate_timestamps", "outlier_ratio",
        F.coalesce(F.try_element_at(found, F.lit(1))["nulls"], F.lit(0).cast("long")).alias("null_values"))
        .select("c.source", F.col("c.rows").alias("source_rows"), "c.percent", "*").drop("c"))
