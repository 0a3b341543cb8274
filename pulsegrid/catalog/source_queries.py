"""S-01..S-18: messages and files derived from the tables, read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import EV_SQL, r6, raw_events, request_events, table, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.rolling_queries import SER, minutes, training_sql
from pulsegrid.catalog.series_queries import H1, dense_sql
from pulsegrid.catalog.stream_features import vector_sql
from pulsegrid.operators.series import fuse, localise, normalise
from pulsegrid.plans import event_features as ef
from pulsegrid.plans.training import build_features
from pulsegrid.schema import FEATURE_COLS, LABEL_COLS
from pulsegrid.session import scratch, use_utc
from pulsegrid.sources import events as E
from pulsegrid.sources import sinks, traces
from pulsegrid.sources.manifest import contributions, ingest


def event_messages(spark, sf):
    """The events table as JSON messages in every shape the decoder accepts, plus broken ones."""
    ev = raw_events(spark, sf)
    kind, ms = F.col("event_type"), F.unix_millis("ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    value = (
        F.when(kind == "click", F.to_json(F.struct(
            F.lit("/c").alias("endpoint"), iso.alias("timestamp"), F.col("value").alias("latency_ms"))))
        .when(kind == "view", F.to_json(F.struct(
            F.lit("/v").alias("endpoint"), ms.alias("ts"), F.col("value").alias("latency_avg"))))
        .when(kind == "purchase", F.to_json(F.struct(
            F.lit("/p").alias("endpoint"), ms.alias("ts"), F.col("value").alias("latency"))))
        .when(kind == "signup", F.to_json(F.struct(F.col("user_id").alias("client_id"))))
        .when(F.col("value") < 20, F.lit('{"endpoint": "/e", '))
        .otherwise(F.to_json(F.struct(F.lit("/e").alias("endpoint"), F.lit("yesterday").alias("timestamp")))))
    return ev.select("event_id", value.alias("value"), F.col("ts").alias("record_time"))


_DECODED = """CASE event_type WHEN 'click' THEN '/c' WHEN 'view' THEN '/v' WHEN 'purchase' THEN '/p' ELSE 'unknown' END"""


@query("s01_event_decode", f"""
  SELECT event_id, {_DECODED} AS endpoint,
    CASE WHEN event_type IN ('view', 'purchase') THEN epoch_ms(epoch_us(ts) // 1000) ELSE ts END AS ts,
    {r6("CASE event_type WHEN 'signup' THEN 10.0 ELSE value END")} AS latency_ms
  FROM events WHERE event_type <> 'error'""")
def s01(spark, sf):
    good, _ = E.split_malformed(E.decode(event_messages(spark, sf)))
    return tidy(good.select("event_id", "endpoint", "ts", "latency_ms"))


@query("s02_malformed_quarantine", """
  SELECT event_id, CASE WHEN value < 20 THEN '{"endpoint": "/e", '
      ELSE '{"endpoint":"/e","timestamp":"yesterday"}' END AS value
  FROM events WHERE event_type = 'error'""")
def s02(spark, sf):
    _, bad = E.split_malformed(E.decode(event_messages(spark, sf)))
    return bad.select("event_id", "value")


@query("s03_event_messages", f"""WITH {EV_SQL}
  SELECT event_id, client_id AS key, json_object('ts', epoch_us(ts) // 1000, 'endpoint', '/api/' || endpoint,
      'method', method, 'client_id', client_id, 'latency_ms', CAST(trunc(latency_ms) AS BIGINT), 'status', status,
      'bytes_sent', bytes_sent)::VARCHAR AS value
  FROM ev WHERE endpoint <> 'view' AND latency_ms <= 200""")
def s03(spark, sf):
    ev = request_events(spark, sf)
    path = F.when(F.col("endpoint") == "view", "/metrics").otherwise(F.concat(F.lit("/api/"), "endpoint"))
    log = ev.withColumn("path", path).withColumn("allowed", F.col("latency_ms") <= 200)
    return E.messages(log)


@query("s04_feature_messages",
       vector_sql().replace("SELECT event_id, endpoint, ts AS timestamp", "SELECT endpoint AS key, endpoint, ts AS timestamp"))
def s04(spark, sf):
    sent = sinks.feature_messages(ef.feature_vectors(request_events(spark, sf, compress=True)))
    good, _ = sinks.parse_feature_messages(sent)
    return tidy(good.withColumn("key", F.col("endpoint")))


@query("s05_point_upsert", f"""
  SELECT event_type AS endpoint, date_trunc('hour', ts) AS timestamp, max(event_id) AS arrival,
    {r6('arg_max(value, event_id)')} AS value FROM events GROUP BY 1, 2""")
def s05(spark, sf):
    points = raw_events(spark, sf).select(
        F.col("event_type").alias("endpoint"), F.date_trunc("hour", "ts").alias("timestamp"),
        F.col("event_id").alias("arrival"), "value")
    return tidy(sinks.latest_per_key(points, ["endpoint", "timestamp"], "arrival"))


@query("s05b_point_upsert_table", f"""
  SELECT event_type AS endpoint, date_trunc('hour', ts) AS timestamp, max(event_id) AS arrival,
    {r6('arg_max(value, event_id)')} AS value FROM events GROUP BY 1, 2""")
def s05b(spark, sf):
    points = raw_events(spark, sf).select(
        F.col("event_type").alias("endpoint"), F.date_trunc("hour", "ts").alias("timestamp"),
        F.col("event_id").alias("arrival"), "value")
    path = scratch(spark, "points")
    sinks.upsert_points(points.filter(F.col("endpoint") != "click"), path)
    sinks.upsert_points(points.filter(F.minute("timestamp") == 0), path)
    return tidy(spark.read.parquet(path).drop("day"))


@query("s06_retention", f"""
  SELECT event_id, ts AS timestamp, {r6('value')} AS value FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 DAY""")
def s06(spark, sf):
    ev = raw_events(spark, sf).select("event_id", F.col("ts").alias("timestamp"), "value")
    return tidy(sinks.retain_days(ev, 15))


def _file(spark, df, name, suffix=".csv", **options):
    path = scratch(spark, name) + suffix
    if suffix == ".parquet":
        df.write.parquet(path)
    else:
        df.write.options(header=True, **options).csv(path)
    return path


def _plain(name, source, columns, sql, suffix=".csv", cfg=None, **options):
    """Write the tables out in a source's file form, read them back, normalise."""
    @query(name, sql)
    def run(spark, sf):
        df = columns(raw_events(spark, sf))
        path = _file(spark, df, name, suffix, **options)
        raw = source(spark, {"path": path, **(cfg or {})})
        return tidy(localise(normalise(raw)))
    return run


def _text_time():
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")



_ALL = f"SELECT ts AS timestamp, {r6('value')} AS value FROM events"

_plain("s07_delimited_csv", traces.delimited, lambda e: e.select(_text_time().alias("when"), "value", "event_type"), _ALL,
       cfg={"timestamp_col": "when", "value_col": "value"})
_plain("s07_delimited_tsv", traces.delimited, lambda e: e.select(_text_time().alias("timestamp"), "value"), _ALL,
       suffix=".tsv", sep="\t")
_plain("s07_parquet", traces.delimited, lambda e: e.select(F.col("ts").alias("timestamp"), "value"), _ALL,
       suffix=".parquet")
_plain("s08_column_resolution", traces.function_invocations,
       lambda e: e.select("event_id", _text_time().alias("Timestamp"), F.col("value").alias("Count")), _ALL)
_plain("s09_function_trace", traces.function_invocations,
       lambda e: e.select(_text_time().alias("end_timestamp"), F.col("event_id").alias("invocations"), "event_type"),
       f"SELECT ts AS timestamp, {r6('event_id')} AS value FROM events")
_plain("s10_vm_trace", traces.vm_utilisation,
       lambda e: e.select(_text_time().alias("timestamp_vm"), F.col("value").alias("avg_cpu")), _ALL)
_plain("s11_google_micros", traces.google_cluster,
       lambda e: e.select(F.unix_micros("ts").alias("start_time"), F.col("value").alias("average_usage.cpus")), _ALL)
_plain("s11_google_millis", traces.google_cluster,
       lambda e: e.select(F.unix_millis("ts").alias("start_time"), F.col("value").alias("avg_cpu")),
       f"SELECT epoch_ms(epoch_us(ts) // 1000) AS timestamp, {r6('value')} AS value FROM events")
_plain("s11_google_text", traces.google_cluster,
       lambda e: e.select(_text_time().alias("start_time"), F.col("value").alias("avg_cpu")), _ALL)
_plain("s12_alibaba_seconds", traces.alibaba_cluster,
       lambda e: e.select(F.unix_seconds("ts").alias("time_stamp"), F.col("value").alias("cpu_util_percent")),
       f"SELECT date_trunc('second', ts) AS timestamp, {r6('value')} AS value FROM events")


@query("s13_access_log", f"""
  SELECT date_trunc('minute', ts) AS timestamp, {r6('count(*)')} AS value FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def s13(spark, sf):
    ev = raw_events(spark, sf)
    local = F.date_format(F.col("ts") - F.expr("INTERVAL 4 HOURS"), "dd/MMM/yyyy:HH:mm:ss")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("host - - [broken] "), "props")).otherwise(
        F.concat(F.lit("10.0.0."), "user_id", F.lit(" - - ["), local, F.lit(' -0400] "GET /api/'), "event_type",
                 F.lit(' HTTP/1.0" 200 512')))
    path = scratch(spark, "access_log")
    ev.select(line.alias("value")).write.text(path, compression="gzip")
    return tidy(traces.access_log(spark, {"path": path}))


@query("s14_pageview_dump", f"""
  SELECT date_trunc('day', ts) AS timestamp, {r6("sum(CASE WHEN event_type <> 'error' THEN event_id END)")} AS value
  FROM events GROUP BY 1""")
def s14(spark, sf):
    ev = raw_events(spark, sf)
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.concat_ws(" ", F.lit("en"), "user_id", F.lit("desktop"), "event_id", F.lit("A1")))
        .when(kind == "error", F.concat_ws(" ", F.lit("en"), "event_id"))
        .otherwise(F.concat_ws(" ", F.lit("en"), "user_id", "event_id", F.lit("0"))))
    path = scratch(spark, "dumps")
    hour = F.date_format("ts", "'pageviews-'yyyyMMdd'-000000'")
    ev.select(line.alias("value"), hour.alias("file")).write.partitionBy("file").text(path, compression="gzip")
    return tidy(traces.pageview_dump(spark, {"path": path}))


_plain("s15_pageview_table", traces.pageviews,
       lambda e: e.select(_text_time().alias("timestamp"), F.col("event_id").alias("views")),
       f"SELECT ts AS timestamp, {r6('event_id')} AS value FROM events")


@query("s16_page_day_matrix", f"""
  WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), u AS (SELECT DISTINCT user_id FROM events),
  v AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY 1, 2)
  SELECT CAST(user_id AS VARCHAR) AS page, day::TIMESTAMP AS day, {r6('views')} AS views
  FROM u CROSS JOIN d LEFT JOIN v USING (user_id, day)""")
def s16(spark, sf):
    ev = raw_events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    wide = ev.groupBy(F.col("user_id").alias("Page")).pivot("day").count()
    path = _file(spark, wide, "matrix")
    out = traces.page_day_matrix(spark, path)
    return tidy(out.withColumn("day", F.col("day").cast("timestamp_ntz")))


def manifest_for(spark, sf):
    """Three sources of different form, one of them switched off and one missing."""
    use_utc(spark)
    ev = raw_events(spark, sf)
    orders = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("end_timestamp"),
        F.col("o_totalprice").alias("invocations"))
    return {
        "fusion_mode": "weighted_mean",
        "sources": [
            {"name": "traffic", "enabled": True, "adapter": "generic", "resample": "1h", "agg": "sum",
             "path": _file(spark, ev.select(_text_time().alias("timestamp"), "value"), "traffic"), "weight": 2.0,
             "multiplier": 3.0, "clip_min": 10.0, "clip_max": 5000.0, "missing_data_policy": "interpolate"},
            {"name": "orders", "enabled": True, "adapter": "azure_functions", "resample": "1h", "agg": "mean",
             "path": _file(spark, orders, "orders"), "filter_start": "1997-01-01", "filter_end": "1997-12-31",
             "missing_data_policy": "drop", "weight": 0.5},
            {"name": "absent", "enabled": True, "adapter": "no_such_adapter", "path": "/nonexistent/file.csv"},
            {"name": "off", "enabled": False, "path": "/nonexistent/off.csv"},
        ],
    }


_INGEST = f"""e AS (SELECT ts AS timestamp, value FROM events),
  o AS (SELECT o_orderdate AS timestamp, o_totalprice AS value FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'),
  {dense_sql('de', 'e', H1, 'sum')}, {dense_sql('dord', 'o', H1, 'avg')},
  tagged AS (SELECT 'traffic' AS source, timestamp, least(greatest(value * 3.0, 10), 5000) AS value, 2.0::DOUBLE AS weight FROM de
    UNION ALL SELECT 'orders', timestamp, value, 0.5 FROM dord WHERE value IS NOT NULL)"""


@query("s17_manifest_ingest", f"""WITH {_INGEST}
  SELECT source, timestamp, {r6('value')} AS value, {r6('weight')} AS weight FROM tagged""")
def s17(spark, sf):
    return tidy(ingest(spark, manifest_for(spark, sf)).select("source", "timestamp", "value", "weight"))


@query("s17b_source_contributions", f"""WITH {_INGEST} SELECT source, count(*) AS rows FROM tagged GROUP BY 1""")
def s17b(spark, sf):
    return contributions(ingest(spark, manifest_for(spark, sf)))


@query("s17c_manifest_fused", f"""WITH {_INGEST}
  SELECT timestamp, {r6('sum(value * weight) / greatest(sum(weight), 1e-9)')} AS req_rate_1m FROM tagged GROUP BY 1""")
def s17c(spark, sf):
    manifest = manifest_for(spark, sf)
    return tidy(fuse(ingest(spark, manifest), manifest["fusion_mode"]))


@query("s18_training_table", training_sql(SER, cast="real"))
def s18(spark, sf):
    path = scratch(spark, "training")
    sinks.write_training_table(build_features(minutes(spark, sf)), path)
    stored = spark.read.parquet(path)
    return stored.select(*[(F.round(F.col(c).cast("double"), 3) + F.lit(0.0)).alias(c) for c in FEATURE_COLS + LABEL_COLS])
