"""W-01..W-11, W-13, W-14, W-17: ordered-series features on the per-minute traffic series."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import EVC_SQL, r6, request_events, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.series_queries import EVS, H1, M1, dense_sql, event_series
from pulsegrid.catalog.stream_features import REACH, calendar_sql, ewma_sql
from pulsegrid.functions.calendar import calendar_features
from pulsegrid.operators import rolling as R
from pulsegrid.operators import series as S
from pulsegrid.plans.training import build_features, future_rate, second_features
from pulsegrid.schema import FEATURE_COLS, LABEL_COLS
from pulsegrid.session import materialise

SER = f"""{EVS.replace("event_type AS source, ", "")}, {dense_sql('d', 's', M1, 'sum')},
  m AS (SELECT timestamp, idx, value AS r FROM d)"""
O = "ORDER BY idx"


def minutes(spark, sf):
    """One dense series: summed value per minute."""
    ev = event_series(spark, sf).drop("source")
    return S.resample(ev, "1min", "sum").withColumnRenamed("value", R.RATE)


def frame(n: int) -> str:
    return f"OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _simple(name, features, cols: dict[str, str], ctes: str = ""):
    @query(name, f"WITH {SER}{ctes} SELECT timestamp, {', '.join(f'{r6(v)} AS {k}' for k, v in cols.items())}"
                 f" FROM {'x' if ctes else 'm'}")
    def run(spark, sf):
        fs = features() if callable(features) else features
        return tidy(R.apply(minutes(spark, sf), *fs).select("timestamp", *cols))
    return run


_simple("w01_rolling_mean", lambda: [R.rolling_mean({"req_rate_5m": 5, "req_rate_15m": 15, "req_rate_30m": 30})],
        {f"req_rate_{n}m": f"avg(r) {frame(n)}" for n in (5, 15, 30)})
_simple("w02_rolling_max", lambda: [R.rolling_max({"req_max_5m": 5, "req_max_15m": 15})],
        {f"req_max_{n}m": f"max(r) {frame(n)}" for n in (5, 15)})
_simple("w03_rolling_std", lambda: [R.rolling_std({"latency_std_5m": 5, "latency_std_15m": 15}, R.RATE)],
        {f"latency_std_{n}m": f"coalesce(stddev_samp(r) {frame(n)}, 0)" for n in (5, 15)})

_LISTS = f""", x AS (SELECT timestamp, idx,
    list(r) OVER ({O} ROWS BETWEEN {REACH[0.3]} PRECEDING AND CURRENT ROW) AS h3,
    list(r) OVER ({O} ROWS BETWEEN {REACH[0.7]} PRECEDING AND CURRENT ROW) AS h7 FROM m)"""
_simple("w04_ewma_recursive", lambda: [R.ewma({"ewma_03": 0.3, "ewma_07": 0.7})],
        {"ewma_03": ewma_sql("h3", 0.3), "ewma_07": ewma_sql("h7", 0.7)}, _LISTS)


def _adjusted(values: str, alpha: float) -> str:
    w = f"power({1 - alpha}::DOUBLE, len({values}) - i)"
    return (f"list_sum(list_transform({values}, lambda v, i: v * {w}))"
            f" / list_sum(list_transform({values}, lambda v, i: {w}))")


_simple("w05_ewma_adjusted", lambda: [R.ewma({"ewma_03": 0.3, "ewma_07": 0.7}, adjust=True)],
        {"ewma_03": _adjusted("h3", 0.3), "ewma_07": _adjusted("h7", 0.7)}, _LISTS)
_simple("w06_rate_of_change", lambda: [R.rate_of_change()],
        {"rate_of_change": f"(r - coalesce(lag(r) OVER ({O}), r)) / greatest(coalesce(lag(r) OVER ({O}), r), 1.0)"})

_PAIRS = f""", y AS (SELECT *, lag(r) OVER ({O}) AS y FROM m),
  x AS (SELECT timestamp, idx, count(y) OVER f AS n, corr(r, y) OVER f AS c,
      least(max(CASE WHEN y IS NOT NULL THEN r END) OVER f - min(CASE WHEN y IS NOT NULL THEN r END) OVER f, max(y) OVER f - min(y) OVER f) AS spread
    FROM y WINDOW f AS ({O} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
_CORR = "CASE WHEN n >= 2 AND spread > 0 AND NOT isnan(c) THEN coalesce(c, 0.0) ELSE 0.0 END"
_simple("w07_autocorrelation", lambda: [R.autocorrelation()], {"autocorr_lag1": _CORR}, _PAIRS)
_simple("w07b_autocorrelation_full", lambda: [R.autocorrelation(full=True)],
        {"autocorr_lag1": f"CASE WHEN n < 60 THEN 0.0 ELSE {_CORR} END"}, _PAIRS)


@query("w08_future_lead", f"""WITH {SER} SELECT timestamp, {r6('r')} AS req_rate_1m,
  {r6(f'coalesce(lead(r, 5) OVER ({O}), (SELECT arg_max(r, timestamp) FROM m))')} AS future_req_rate_5m FROM m""")
def w08(spark, sf):
    return tidy(future_rate(materialise(minutes(spark, sf))).select("timestamp", R.RATE, "future_req_rate_5m"))


@query("w09_future_mean", f"""WITH {SER} SELECT timestamp, {r6('v')} AS future FROM (
  SELECT timestamp, avg(r) OVER (ROWS_AHEAD) AS v, lead(idx, 300) OVER ({O}) AS full_window FROM m)
  WHERE full_window IS NOT NULL""".replace("ROWS_AHEAD", f"{O} ROWS BETWEEN 1 FOLLOWING AND 300 FOLLOWING"))
def w09(spark, sf):
    out = R.apply(minutes(spark, sf), R.future_mean()).filter(F.col("future").isNotNull())
    return tidy(out.select("timestamp", "future"))


@query("w10_second_features", f"""
  WITH {EVC_SQL}, c AS (SELECT endpoint, sec, count(*) AS n, avg(latency_ms) AS lat FROM ev GROUP BY ALL),
  g AS (SELECT endpoint, unnest(range(min(sec), max(sec) + 1)) AS sec FROM c GROUP BY endpoint),
  s AS (SELECT endpoint, sec, coalesce(n, 0) AS n, last_value(lat IGNORE NULLS) OVER
      (PARTITION BY endpoint ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lat
    FROM g LEFT JOIN c USING (endpoint, sec))
  SELECT endpoint, epoch_ms(sec * 1000) AS timestamp,
    {", ".join(f"{r6(f'avg(n) OVER (PARTITION BY endpoint ORDER BY sec ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)')} AS req_rate_{k // 60}m" for k in (60, 300, 900, 1800))},
    {", ".join(f"{r6(f'max(n) OVER (PARTITION BY endpoint ORDER BY sec ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)')} AS req_max_{k // 60}m" for k in (300, 900))},
    {", ".join(f"{r6(f'coalesce(stddev_samp(lat) OVER (PARTITION BY endpoint ORDER BY sec ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0)')} AS latency_std_{k // 60}m" for k in (300, 900))}
  FROM s""")
def w10(spark, sf):
    return tidy(second_features(request_events(spark, sf, compress=True)))


_CAL0 = calendar_sql("timestamp", 0)


@query("w11_calendar_batch", f"""WITH {SER} SELECT timestamp, {", ".join(f"{r6(v)} AS {k}" for k, v in _CAL0.items())} FROM m""")
def w11(spark, sf):
    cols = calendar_features(F.col("timestamp"))
    return tidy(minutes(spark, sf).select("timestamp", *[c.alias(k) for k, c in cols.items()]))


@query("w13_gap_detection", f"""
  SELECT source, after, before, {r6('(epoch_us(before) - epoch_us(after)) / 1e6')} AS gap_seconds FROM (
    SELECT event_type AS source, ts AS before, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS after FROM events)
  WHERE epoch_us(before) - epoch_us(after) > 2 * 1200 * 1000000::BIGINT""")
def w13(spark, sf):
    return tidy(S.gaps(event_series(spark, sf), "20min", keys=["source"]))


_OUT = f"""WITH {EVS}, {dense_sql('d', 's', H1, 'sum', 'source')},
  z AS (SELECT source, timestamp, value, idx,
      quantile_cont(value, 0.5) OVER f AS med, coalesce(stddev_samp(value) OVER f, 1) AS sd
    FROM d WINDOW f AS (PARTITION BY source ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
  flags AS (SELECT *, abs((value - med) / greatest(sd, 1e-6)) > 3 AS is_outlier FROM z)"""


@query("w14_outlier_flags", f"{_OUT} SELECT source, timestamp, is_outlier FROM flags")
def w14(spark, sf):
    hourly = S.resample(event_series(spark, sf), "1h", "sum", keys=["source"])
    return tidy(R.outlier_flags(hourly, "value", keys=["source"]).select("source", "timestamp", "is_outlier"))


@query("w14b_outlier_ratio", f"""{_OUT} SELECT source, {r6('CASE WHEN count(*) < 60 THEN 0 ELSE count(*) FILTER (is_outlier) / count(*)::DOUBLE END')} AS outlier_ratio
  FROM flags GROUP BY source""")
def w14b(spark, sf):
    hourly = S.resample(event_series(spark, sf), "1h", "sum", keys=["source"])
    return tidy(R.outlier_ratio(hourly, "value", keys=["source"]))


_LOAD = "(CASE WHEN (SELECT max(r) FROM m) > 0 THEN r / (SELECT max(r) FROM m) ELSE 0 END)"


def training_sql(ser: str = SER, cast: str | None = None) -> str:
    cols = dict(_CAL0)
    cols |= {f"req_rate_{n}m": f"avg(r) {frame(n)}" for n in (5, 15, 30)}
    cols |= {"req_rate_1m": "r"}
    cols |= {f"req_max_{n}m": f"max(r) {frame(n)}" for n in (5, 15)}
    cols |= {f"latency_std_{n}m": f"coalesce(stddev_samp(lat) {frame(n)}, 0)" for n in (5, 15)}
    cols |= {"ewma_03": ewma_sql("h3", 0.3), "ewma_07": ewma_sql("h7", 0.7)}
    cols |= {"rate_of_change": f"(r - coalesce(lag(r) OVER ({O}), r)) / greatest(coalesce(lag(r) OVER ({O}), r), 1.0)"}
    cols |= {"autocorr_lag1": _CORR}
    cols |= {"cpu_util": "cpu", "memory_pressure": "cpu", "active_connections": "greatest(0.2 * r, 1)",
             "cache_hit_ratio": "0.5", "replica_count": "1", "queue_depth": "0"}
    cols |= {"future_req_rate_5m": f"coalesce(lead(r, 5) OVER ({O}), (SELECT arg_max(r, timestamp) FROM m))",
             "is_surge": "CASE WHEN r > greatest(1, 3 * (SELECT median(r) FROM m)) THEN 1 ELSE 0 END"}

    def out(expr):
        return f"round(CAST(CAST({expr} AS REAL) AS DOUBLE), 3) + 0.0::DOUBLE" if cast else r6(expr)

    return f"""WITH {ser}{_PAIRS.replace("x AS", "p AS")}{_LISTS.replace("x AS", "l AS")},
      b AS (SELECT m.*, h3, h7, n, c, spread, greatest(10 + 90 * {_LOAD}, 1) AS lat,
          least(greatest(0.1 + 0.7 * {_LOAD}, 0.05), 0.99) AS cpu
        FROM m JOIN p USING (idx) JOIN l USING (idx))
      SELECT {"" if cast else "timestamp, "}{", ".join(f"{out(cols[c])} AS {c}" for c in FEATURE_COLS + LABEL_COLS)} FROM b"""


@query("w17_training_features", training_sql())
def w17(spark, sf):
    return tidy(build_features(minutes(spark, sf)))
