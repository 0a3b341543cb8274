"""T-01..T-09, W-12, A-01, A-02: trailing-window features of request events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import EVC_SQL, r6, request_events, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.functions.calendar import calendar_features
from pulsegrid.plans import event_features as ef
from pulsegrid.schema import FEATURE_COLS

WINDOWS = (60, 300, 900, 1800)
REACH = {0.3: 104, 0.7: 31}  # rows that weigh more than 1e-16

SEC_SQL = """secs AS (
  SELECT endpoint, sec, count(*)::BIGINT AS cnt, arg_max(latency_ms, (ms, event_id)) AS last_lat
  FROM ev GROUP BY endpoint, sec)"""


def _frame_cols() -> str:
    cols = []
    for n in WINDOWS:
        for e, back in (("c", n), ("o", n - 1)):
            over = f"OVER (PARTITION BY endpoint ORDER BY sec RANGE BETWEEN {back} PRECEDING AND 1 PRECEDING)"
            cols.append(f"coalesce(sum(cnt) {over}, 0) AS tot{n}_{e}")
            if n in (300, 900):
                cols.append(f"coalesce(max(cnt) {over}, 0) AS max{n}_{e}")
                cols.append(f"count(last_lat) {over} AS n{n}_{e}")
                cols.append(f"coalesce(avg(last_lat) {over}, 0) AS mean{n}_{e}")
                cols.append(f"coalesce(var_pop(last_lat) {over}, 0) AS var{n}_{e}")
    return ",\n    ".join(cols)


def _pick(name: str) -> str:
    return f"(CASE WHEN ms % 1000 = 0 THEN {name}_c ELSE {name}_o END)"


def _std(n: int) -> str:
    k, mean, var = (_pick(f"{p}{n}") for p in ("n", "mean", "var"))
    return (f"(CASE WHEN {k} < 1 THEN 0 ELSE sqrt(({k} * {var} + (latency_ms - {mean}) * (latency_ms - {mean})"
            f" * {k} / ({k} + 1.0)) / {k}) END)")


WIN_SQL = f"""frames AS (
  SELECT endpoint, sec,
    {_frame_cols()}
  FROM secs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY endpoint, sec ORDER BY ms, event_id) AS rn FROM ev),
wins AS (
  SELECT event_id, endpoint, ms, ts,
    {", ".join(f"CAST({_pick(f'tot{n}')} + rn AS BIGINT) AS total_{n}s" for n in WINDOWS)},
    {", ".join(f"CAST(greatest({_pick(f'max{n}')}, rn) AS BIGINT) AS max_{n}s" for n in (300, 900))},
    {", ".join(f"{_std(n)} AS latency_std_{n}s" for n in (300, 900))}
  FROM ranked JOIN frames USING (endpoint, sec))"""

BASE_SQL = f"WITH {EVC_SQL},\n{SEC_SQL},\n{WIN_SQL}"

ORDER = "PARTITION BY endpoint ORDER BY ms, event_id"


def _corr_sql(n: str, sx: str, sy: str, sxy: str, sxx: str, syy: str) -> str:
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return (f"CASE WHEN {n} < 2 OR {vx} <= 1e-9 * {n} * {sxx} OR {vy} <= 1e-9 * {n} * {syy} THEN 0.0"
            f" ELSE ({n} * {sxy} - {sx} * {sy}) / (sqrt({vx}) * sqrt({vy})) END")


def ewma_sql(values: str, alpha: float) -> str:
    return f"list_reduce({values}, lambda e, x: {alpha}::DOUBLE * x + {1 - alpha}::DOUBLE * e)"


HIST_SQL = f"""rated AS (SELECT *, total_60s / 60.0::DOUBLE AS r FROM wins),
lagged AS (
  SELECT *, lag(r, 1) OVER ({ORDER}) AS prev, lag(total_60s, 1) OVER ({ORDER})::DOUBLE AS y,
         CASE WHEN lag(total_60s, 1) OVER ({ORDER}) IS NOT NULL THEN total_60s::DOUBLE END AS x FROM rated),
hist AS (
  SELECT *,
    list(r) OVER ({ORDER} ROWS BETWEEN {REACH[0.3]} PRECEDING AND CURRENT ROW) AS h3,
    list(r) OVER ({ORDER} ROWS BETWEEN {REACH[0.7]} PRECEDING AND CURRENT ROW) AS h7,
    count(y) OVER f AS n, sum(x) OVER f AS sx, sum(y) OVER f AS sy,
    sum(x * y) OVER f AS sxy, sum(x * x) OVER f AS sxx, sum(y * y) OVER f AS syy
  FROM lagged WINDOW f AS ({ORDER} ROWS BETWEEN 58 PRECEDING AND CURRENT ROW))"""

EWMA3, EWMA7 = ewma_sql("h3", 0.3), ewma_sql("h7", 0.7)
ROC = "(r - coalesce(prev, 0.0)) / greatest(coalesce(prev, 0.0), 1.0)"
AUTOCORR = _corr_sql("n", "sx", "sy", "sxy", "sxx", "syy")


def calendar_sql(ts: str, monday: int) -> dict[str, str]:
    h, d = f"hour({ts})", f"(isodow({ts}) - 1 + {monday})"
    return {
        "hour_sin": f"sin(2 * pi() * {h} / 24.0)", "hour_cos": f"cos(2 * pi() * {h} / 24.0)",
        "dow_sin": f"sin(2 * pi() * {d} / 7.0)", "dow_cos": f"cos(2 * pi() * {d} / 7.0)",
        "week_of_year": f"week({ts})", "is_weekend": f"CASE WHEN isodow({ts}) >= 6 THEN 1 ELSE 0 END",
        "is_holiday": "0", "day_of_month": f"day({ts})",
    }


@query("a01_events_per_second", f"WITH {EVC_SQL}, {SEC_SQL} SELECT endpoint, sec, cnt FROM secs")
def a01(spark, sf):
    return ef.per_second(request_events(spark, sf, compress=True)).select("endpoint", "sec", "cnt")


@query("a02_last_latency_per_second",
       f"WITH {EVC_SQL}, {SEC_SQL} SELECT endpoint, sec, {r6('last_lat')} AS last_latency FROM secs")
def a02(spark, sf):
    return tidy(ef.per_second(request_events(spark, sf, compress=True)).select("endpoint", "sec", "last_latency"))


def _windows(spark, sf):
    return ef.trailing_windows(
        request_events(spark, sf, compress=True).select("event_id", "ts", "endpoint", "latency_ms"))


@query("t01_trailing_totals",
       f"{BASE_SQL} SELECT event_id, endpoint, {', '.join(f'total_{n}s' for n in WINDOWS)} FROM wins")
def t01(spark, sf):
    return _windows(spark, sf).select("event_id", "endpoint", *[f"total_{n}s" for n in WINDOWS])


_RATE_COLS = {60: "req_rate_1m", 300: "req_rate_5m", 900: "req_rate_15m", 1800: "req_rate_30m"}


@query("t02_request_rates",
       f"{BASE_SQL} SELECT event_id, endpoint, "
       + ", ".join(f"{r6(f'total_{n}s / {n}.0')} AS {c}" for n, c in _RATE_COLS.items()) + " FROM wins")
def t02(spark, sf):
    return tidy(ef.rates(_windows(spark, sf)).select("event_id", "endpoint", *_RATE_COLS.values()))


@query("t03_peak_per_second", f"{BASE_SQL} SELECT event_id, endpoint, max_300s, max_900s FROM wins")
def t03(spark, sf):
    return _windows(spark, sf).select("event_id", "endpoint", "max_300s", "max_900s")


@query("t04_latency_deviation",
       f"{BASE_SQL} SELECT event_id, endpoint, {r6('latency_std_300s')} AS latency_std_5m,"
       f" {r6('latency_std_900s')} AS latency_std_15m FROM wins")
def t04(spark, sf):
    return tidy(_windows(spark, sf).select(
        "event_id", "endpoint", F.col("latency_std_300s").alias("latency_std_5m"),
        F.col("latency_std_900s").alias("latency_std_15m")))


def _history(spark, sf):
    return ef.rate_history(ef.rates(_windows(spark, sf)))


@query("t05_event_ewma",
       f"{BASE_SQL}, {HIST_SQL} SELECT event_id, endpoint, {r6(EWMA3)} AS ewma_03, {r6(EWMA7)} AS ewma_07 FROM hist")
def t05(spark, sf):
    return tidy(_history(spark, sf).select("event_id", "endpoint", "ewma_03", "ewma_07"))


@query("t06_event_rate_of_change",
       f"{BASE_SQL}, {HIST_SQL} SELECT event_id, endpoint, {r6(ROC)} AS rate_of_change FROM hist")
def t06(spark, sf):
    return tidy(_history(spark, sf).select("event_id", "endpoint", "rate_of_change"))


@query("t07_event_autocorrelation",
       f"{BASE_SQL}, {HIST_SQL} SELECT event_id, endpoint, {r6(AUTOCORR)} AS autocorr_lag1 FROM hist")
def t07(spark, sf):
    return tidy(_history(spark, sf).select("event_id", "endpoint", "autocorr_lag1"))


@query("t08_infra_placeholders",
       f"WITH {EVC_SQL} SELECT event_id, endpoint, "
       + ", ".join(f"{r6(str(v))} AS {k}" for k, v in ef.INFRA_DEFAULTS.items()) + " FROM ev")
def t08(spark, sf):
    ev = request_events(spark, sf, compress=True)
    return tidy(ef.with_infra(ev).select("event_id", "endpoint", *ef.INFRA_DEFAULTS))


@query("t08b_infra_from_minute_table",
       f"""WITH {EVC_SQL}, infra AS (
         SELECT endpoint, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, avg(latency_ms) / 100.0 AS cpu_util,
                count(*) AS active_connections
         FROM ev WHERE status = 200 GROUP BY ALL)
       SELECT event_id, ev.endpoint, {r6('coalesce(cpu_util, 0.45)')} AS cpu_util,
              {r6('coalesce(active_connections, 1)')} AS active_connections, {r6('0.5')} AS cache_hit_ratio
       FROM ev LEFT JOIN infra ON infra.endpoint = ev.endpoint
        AND infra.minute = time_bucket(INTERVAL 1 MINUTE, ev.ts)""")
def t08b(spark, sf):
    ev = request_events(spark, sf, compress=True)
    infra = ev.filter("status = 200").groupBy("endpoint", F.date_trunc("minute", "ts").alias("minute")).agg(
        (F.avg("latency_ms") / 100.0).alias("cpu_util"), F.count(F.lit(1)).alias("active_connections"))
    return tidy(ef.with_infra(ev, infra).select(
        "event_id", "endpoint", "cpu_util", "active_connections", "cache_hit_ratio"))


_CAL1 = calendar_sql("ts", 1)


@query("w12_calendar_stream",
       f"WITH {EVC_SQL} SELECT event_id, " + ", ".join(f"{r6(v)} AS {k}" for k, v in _CAL1.items()) + " FROM ev")
def w12(spark, sf):
    ev = request_events(spark, sf, compress=True)
    return tidy(ev.select("event_id", *[c.alias(k) for k, c in calendar_features(F.col("ts"), monday=1).items()]))


def vector_sql(prefix: str = BASE_SQL) -> str:
    cols = dict(_CAL1)
    cols |= {c: f"total_{n}s / {n}.0" for n, c in _RATE_COLS.items()}
    cols |= {"latency_std_5m": "latency_std_300s", "latency_std_15m": "latency_std_900s",
             "req_max_5m": "max_300s", "req_max_15m": "max_900s",
             "ewma_03": EWMA3, "ewma_07": EWMA7, "rate_of_change": ROC, "autocorr_lag1": AUTOCORR}
    cols |= {k: str(v) for k, v in ef.INFRA_DEFAULTS.items()}
    return (f"{prefix}, {HIST_SQL} SELECT event_id, endpoint, ts AS timestamp, "
            + ", ".join(f"{r6(cols[c])} AS {c}" for c in FEATURE_COLS) + " FROM hist")


@query("t09_feature_vectors", vector_sql())
def t09(spark, sf):
    return tidy(ef.feature_vectors(request_events(spark, sf, compress=True)))
