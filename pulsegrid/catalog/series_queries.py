"""P-01..05, A-03..10, J-01, U-01/02, W-15/16 on series derived from the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import r6, raw_events, table, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.operators import series as S
from pulsegrid.plans.training import surge_flags
from pulsegrid.session import materialise


def event_series(spark, sf, kind: str | None = None):
    ev = raw_events(spark, sf)
    if kind:
        ev = ev.filter(F.col("event_type") == kind)
    return ev.select(F.col("event_type").alias("source"), F.col("ts").alias("timestamp"), "value")


def day_series(spark, sf):
    """Three sources at day resolution with weights."""
    def src(df, name, ts, value, weight):
        return df.select(F.lit(name).alias("source"), F.col(ts).cast("timestamp").alias("timestamp"),
                         F.col(value).alias("value"), F.lit(weight).alias("weight"))

    frames = [
        S.resample(src(table(spark, sf, t), n, ts, v, w), "1d", "sum", keys=["source", "weight"])
        for t, n, ts, v, w in (("events", "clicks", "ts", "value", 1.0),
                               ("orders", "orders", "o_orderdate", "o_totalprice", 1.3),
                               ("lineitem", "items", "l_shipdate", "l_quantity", 0.5))]
    return S.union_all(frames)


def dense_sql(name: str, src: str, step: str, agg: str, key: str | None = None) -> str:
    """CTEs for a dense resample anchored at midnight of the first day."""
    by = f"{key}, " if key else ""
    on = f"a.{key} = g.{key} AND " if key else ""
    expr = {"sum": "coalesce(a.v, 0)"}.get(agg, "a.v")
    group = f"GROUP BY {key}" if key else ""
    joined = f"{src} JOIN {name}_b USING ({key})" if key else f"{src}, {name}_b"
    cut = f"o + to_microseconds((epoch_us(timestamp) - epoch_us(o)) // epoch_us({step}) * epoch_us({step}))"
    return f"""{name}_b AS (SELECT {by}date_trunc('day', min(timestamp)) AS o, min(timestamp) AS lo, max(timestamp) AS hi
       FROM {src} {group}),
    {name}_a AS (SELECT {by}{cut} AS bin, {agg}(value) AS v FROM {joined} GROUP BY ALL),
    {name}_g AS (SELECT {by}unnest(generate_series(min(bin), max(bin), {step})) AS bin FROM {name}_a {group}),
    {name} AS (SELECT {"g." + by if key else ""}g.bin AS timestamp, {expr} AS value,
       row_number() OVER ({f"PARTITION BY g.{key} " if key else ""}ORDER BY g.bin) - 1 AS idx
       FROM {name}_g g LEFT JOIN {name}_a a ON {on}a.bin = g.bin)"""


EVS = "s AS (SELECT event_type AS source, ts AS timestamp, value FROM events)"
EVE = "s AS (SELECT event_type AS source, ts AS timestamp, value FROM events WHERE event_type = 'error')"
H1, M1 = "INTERVAL 1 HOUR", "INTERVAL 1 MINUTE"


@query("p01_normalise", f"""
  SELECT event_id, ts AS timestamp, {r6('value')} AS value FROM events WHERE event_type <> 'click' AND value >= 1""")
def p01(spark, sf):
    ev = raw_events(spark, sf)
    raw = ev.select(
        "event_id",
        F.when(F.col("event_type") == "click", "not a time").otherwise(F.col("ts").cast("string")).alias("t"),
        F.when(F.col("value") < 1, "n/a").otherwise(F.col("value").cast("string")).alias("v"))
    return tidy(S.normalise(raw, "t", "v", ["event_id"]).drop("aware"))


@query("p02_localise", f"""
  SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS timestamp, {r6('value')} AS value FROM events""")
def p02(spark, sf):
    ev = raw_events(spark, sf).select("event_id", F.col("ts").alias("timestamp"), "value")
    return tidy(S.localise(ev, "America/New_York"))


@query("p03_time_range", f"""
  SELECT event_id, ts, {r6('value')} AS value FROM events
  WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'""")
def p03(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    return tidy(S.time_range(ev, "2024-01-05 00:00:00", "2024-01-12 12:00:00", "ts"))


@query("p04_multiply", f"SELECT event_id, {r6('value * 2.5')} AS value FROM events")
def p04(spark, sf):
    return tidy(S.multiply(raw_events(spark, sf).select("event_id", "value"), 2.5))


@query("p05_clip", f"""
  WITH {EVS}, {dense_sql('d', 's', H1, 'avg', 'source')}
  SELECT source, timestamp, {r6('least(greatest(value * 2.0, 60.0), 150.0)')} AS value FROM d WHERE value IS NOT NULL
  UNION ALL SELECT source, timestamp, NULL FROM d WHERE value IS NULL""")
def p05(spark, sf):
    hourly = S.resample(event_series(spark, sf), "1h", "mean", keys=["source"]).drop("idx")
    return tidy(S.clip_values(S.multiply(hourly, 2.0), 60.0, 150.0))


def _resample(name, agg, interval, step, sql_agg):
    @query(name, f"WITH {EVS}, {dense_sql('d', 's', step, sql_agg, 'source')}"
                 f" SELECT source, timestamp, {r6('value')} AS value FROM d")
    def run(spark, sf):
        return tidy(S.resample(event_series(spark, sf), interval, agg, keys=["source"]).drop("idx"))
    return run


_resample("a03_resample_sum", "sum", "7min", "INTERVAL 7 MINUTE", "sum")
_resample("a03_resample_mean", "mean", "1h", H1, "avg")
_resample("a03_resample_max", "max", "5min", "INTERVAL 5 MINUTE", "max")
_resample("a03_resample_min", "min", "2h", "INTERVAL 2 HOUR", "min")
_resample("a03_resample_unknown_is_sum", "median", "1h", H1, "sum")


def _missing(name, policy, expr, where=""):
    @query(name, f"""
      WITH {EVS}, {dense_sql('d', 's', 'INTERVAL 10 MINUTE', 'avg', 'source')},
      n AS (SELECT *,
          last_value(value IGNORE NULLS) OVER b AS pv, first_value(value IGNORE NULLS) OVER a AS nv,
          last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS pi,
          first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS ni
        FROM d WINDOW b AS (PARTITION BY source ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          a AS (PARTITION BY source ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT source, timestamp, {r6(expr)} AS value FROM n {where}""")
    def run(spark, sf):
        d = S.resample(event_series(spark, sf), "10min", "mean", keys=["source"]).drop("idx")
        return tidy(S.handle_missing(d, policy, keys=["source"]))
    return run


_missing("a04_missing_drop", "drop", "value", "WHERE value IS NOT NULL")
_missing("a04_missing_zero", "zero", "coalesce(value, 0)")
_missing("a04_missing_ffill", "ffill", "coalesce(pv, nv)")
_missing("a04_missing_interpolate", "interpolate",
         "CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN pi = ni THEN pv"
         " ELSE pv + (nv - pv) * (idx - pi)::DOUBLE / (ni - pi) END")

DAYS = f"""e AS (SELECT ts AS timestamp, value FROM events),
  o AS (SELECT o_orderdate AS timestamp, o_totalprice AS value FROM orders),
  l AS (SELECT l_shipdate AS timestamp, l_quantity AS value FROM lineitem),
  {dense_sql('de', 'e', 'INTERVAL 1 DAY', 'sum')}, {dense_sql('dd', 'o', 'INTERVAL 1 DAY', 'sum')},
  {dense_sql('dl', 'l', 'INTERVAL 1 DAY', 'sum')},
  tagged AS (SELECT 'clicks' AS source, timestamp, value, 1.0 AS weight FROM de
    UNION ALL SELECT 'orders', timestamp, value, 1.3 FROM dd
    UNION ALL SELECT 'items', timestamp, value, 0.5 FROM dl)"""


@query("u01_union_sources", f"WITH {DAYS} SELECT source, timestamp, {r6('value')} AS value, {r6('weight')} AS weight FROM tagged")
def u01(spark, sf):
    return tidy(day_series(spark, sf).select("source", "timestamp", "value", "weight"))


@query("a05_fuse_sum", f"WITH {DAYS} SELECT timestamp, {r6('sum(value)')} AS req_rate_1m FROM tagged GROUP BY timestamp")
def a05(spark, sf):
    return tidy(S.fuse(day_series(spark, sf), "sum"))


@query("a06_fuse_weighted_mean", f"""WITH {DAYS}
  SELECT timestamp, {r6('sum(value * weight::DOUBLE) / greatest(sum(weight::DOUBLE), 1e-9)')} AS req_rate_1m
  FROM tagged GROUP BY timestamp""")
def a06(spark, sf):
    return tidy(S.fuse(day_series(spark, sf), "weighted_mean"))


TOP = """top AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 500),
  daily AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS value FROM lineitem
    WHERE l_partkey IN (SELECT l_partkey FROM top) GROUP BY 1)"""


def _daily(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    return S.top_entity_series(items, "l_partkey", "day", "l_quantity", 500)


@query("a07_top_entities_daily", f"WITH {TOP} SELECT day::TIMESTAMP AS day, {r6('value')} AS value FROM daily")
def a07(spark, sf):
    return tidy(_daily(spark, sf).withColumn("day", F.col("day").cast("timestamp_ntz")))


@query("a08_mean_fill_first_30", f"""
  WITH s AS (SELECT ts AS timestamp, value FROM events), {dense_sql('d', 's', 'INTERVAL 10 SECOND', 'avg')},
  f AS (SELECT timestamp, value FROM d ORDER BY timestamp LIMIT 30)
  SELECT timestamp, {r6('coalesce(value, (SELECT avg(value) FROM f))')} AS value FROM f""")
def a08(spark, sf):
    """The first steps of the series of all events, on a grid fine enough to leave holes."""
    d = S.resample(event_series(spark, sf).drop("source"), "10s", "mean").drop("idx")
    return tidy(S.mean_fill(S.first_steps(d, "timestamp", 30)))


@query("a09_min_max_scale", f"""
  SELECT event_id, {r6('100 + (value - (SELECT min(value) FROM events)) / ((SELECT max(value) - min(value) FROM events)) * 4900')} AS rate,
    {r6('0.1 + (value - (SELECT min(value) FROM events)) / ((SELECT max(value) - min(value) FROM events) + 1e-5) * 0.85')} AS cpu
  FROM events""")
def a09(spark, sf):
    ev = raw_events(spark, sf).select("event_id", "value")
    both = S.scale_min_max(S.scale_min_max(ev, "value", 100.0, 5000.0, out="rate"), "value", 0.1, 0.95, eps=1e-5, out="cpu")
    return tidy(both.select("event_id", "rate", "cpu"))


@query("a10_surge_baseline", f"""
  WITH {EVS}, {dense_sql('d', 's', H1, 'sum', 'source')},
  m AS (SELECT source, median(value) AS m FROM d GROUP BY source)
  SELECT source, timestamp, {r6('value')} AS req_rate_1m,
    {r6('CASE WHEN value > greatest(1, 3 * m) THEN 1 ELSE 0 END')} AS is_surge FROM d JOIN m USING (source)""")
def a10(spark, sf):
    d = S.resample(event_series(spark, sf), "1h", "sum", keys=["source"]).withColumnRenamed("value", "req_rate_1m")
    return tidy(surge_flags(materialise(d.drop("idx")), keys=["source"]))


@query("j01_align_by_position", f"""
  WITH s AS (SELECT ts AS timestamp, value FROM events), {dense_sql('d', 's', M1, 'sum')},
  t AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, o_totalprice FROM orders)
  SELECT timestamp, {r6('value')} AS value, {r6('o_totalprice')} AS o_totalprice
  FROM d JOIN t ON t.i = d.idx % (SELECT count(*) FROM orders)""")
def j01(spark, sf):
    d = S.resample(event_series(spark, sf).drop("source"), "1min", "sum")
    orders = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    out = S.align_by_position(d, orders, "o_totalprice", order=["o_orderdate", "o_orderkey"])
    return tidy(out.select("timestamp", "value", "o_totalprice"))


@query("u02_pivot_unpivot", f"""
  WITH w AS (SELECT CAST(ts AS DATE)::TIMESTAMP AS day, event_type AS field, sum(value) AS total FROM events GROUP BY ALL)
  SELECT day, {", ".join(f"{r6(f'max(CASE WHEN field = {chr(39)}{k}{chr(39)} THEN total END)')} AS {k}" for k in ("click", "error", "purchase", "signup", "view"))}
  FROM w GROUP BY day""")
def u02(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    ev = raw_events(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    wide = ev.groupBy("day").pivot("event_type", kinds).agg(F.sum("value"))
    long = wide.unpivot("day", kinds, "field", "total")
    return tidy(long.groupBy("day").pivot("field", kinds).agg(F.max("total")))


WEIGHTS = ", ".join(f"({h}, {w!r})" for h, w in enumerate(math.sin(math.pi * (h - 6) / 12) ** 2 + 0.2 for h in range(24)))


@query("w15_spread_over_day", f"""
  WITH {TOP}, w(h, w) AS (VALUES {WEIGHTS})
  SELECT day::TIMESTAMP + to_hours(h) AS timestamp, {r6('value * w::DOUBLE / (SELECT sum(w::DOUBLE) FROM w)')} AS value
  FROM daily, w""")
def w15(spark, sf):
    return tidy(S.spread_over_day(_daily(spark, sf), "day", "value"))


@query("w16_upsample_linear", f"""
  WITH s AS (SELECT ts AS timestamp, value FROM events), {dense_sql('d', 's', H1, 'sum')},
  m AS (SELECT count(*) AS m FROM d),
  p AS (SELECT i, i * (m - 1) // (m * 60 - 1) AS j, (i * (m - 1)) % (m * 60 - 1) / (m * 60 - 1)::DOUBLE AS f
        FROM m, range(m * 60) r(i))
  SELECT i, {r6('a.value + (coalesce(b.value, a.value) - a.value) * f')} AS value
  FROM p JOIN d a ON a.idx = p.j LEFT JOIN d b ON b.idx = p.j + 1""")
def w16(spark, sf):
    hourly = S.resample(event_series(spark, sf).drop("source"), "1h", "sum").drop("idx")
    return tidy(S.upsample_linear(hourly, 60))
