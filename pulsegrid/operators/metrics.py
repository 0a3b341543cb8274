"""Request metrics: counters, rates, latency histograms, error shares, gauges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import interval_seconds
from pulsegrid.functions.web import status_matches
from pulsegrid.operators.ordered import null_safe_join
from pulsegrid.operators.quantiles import exact_percentiles
from pulsegrid.operators.series import handle_missing, resample

# Upper bounds of the latency buckets, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
# Dashboard bands as (lower bound, label), highest first.
CACHE_BANDS = ((85.0, "green"), (70.0, "yellow"), (float("-inf"), "red"))
LIMIT_BANDS = ((50.0, "red"), (10.0, "yellow"), (float("-inf"), "green"))
STATUS_NAMES = {0: "IDLE", 1: "ACTIVE"}


def bucket(ts: str = "ts", interval: str = "1min") -> Column:
    step = interval_seconds(interval) * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(step)) * F.lit(step))


def request_rates(events: DataFrame, by: Sequence[str], *, interval: str = "1min", ts: str = "ts") -> DataFrame:
    """Count (increase) and per-second rate per window and label set."""
    n = F.count(F.lit(1))
    return events.groupBy(bucket(ts, interval).alias("window_start"), *by).agg(
        n.alias("increase"), (n / F.lit(float(interval_seconds(interval)))).alias("rate"))


def totals(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def _le(bound: float) -> str:
    return "le_" + f"{bound:g}".replace(".", "_")


LE_NAMES = [_le(b) for b in LATENCY_BOUNDS]


def latency_histogram(events: DataFrame, by: Sequence[str | Column], seconds: Column) -> DataFrame:
    """Cumulative bucket counts, one column per bound plus ``le_inf``, in one pass."""
    return events.withColumn("_s", seconds).groupBy(*by).agg(
        *[F.count_if(F.col("_s") <= b).alias(n) for b, n in zip(LATENCY_BOUNDS, LE_NAMES)],
        F.count("_s").alias("le_inf"))


def histogram_quantile(hist: DataFrame, q: float, out: str = "quantile") -> DataFrame:
    """Quantile by linear interpolation inside the bucket; the first bucket starts at 0 and the
    unbounded one yields the highest finite bound. NULL for an empty histogram."""
    bounds = F.array(*[F.lit(float(b)) for b in LATENCY_BOUNDS])
    counts = F.array(*[F.col(n).cast("double") for n in LE_NAMES])
    rank = F.lit(q) * F.col("le_inf")
    below = F.size(F.filter(counts, lambda c: c < rank))  # buckets that end before the rank
    lower = F.when(below == 0, F.lit(0.0)).otherwise(F.get(bounds, below - 1))
    before = F.when(below == 0, F.lit(0.0)).otherwise(F.get(counts, below - 1))
    inside = lower + (F.get(bounds, below) - lower) * F.try_divide(rank - before, F.get(counts, below) - before)
    value = F.when(F.col("le_inf") == 0, F.lit(None)).when(
        below >= len(LATENCY_BOUNDS), F.lit(float(LATENCY_BOUNDS[-1]))).otherwise(inside)
    return hist.withColumn(out, value)


def latency_quantile_ms(events: DataFrame, by: Sequence[str], *, q: float = 0.95, interval: str = "1min",
                        ts: str = "ts", latency: str = "latency_ms") -> DataFrame:
    """Bucketed latency quantile per window in milliseconds."""
    hist = latency_histogram(events, [bucket(ts, interval).alias("window_start"), *by], F.col(latency) / 1000.0)
    return histogram_quantile(hist, q).select(
        "window_start", *by, (F.col("quantile") * 1000.0).alias("latency_ms"))


def exact_latency_quantile(events: DataFrame, by: Sequence[str], *, q: float = 0.95, interval: str = "1min",
                           ts: str = "ts", latency: str = "latency_ms") -> DataFrame:
    stamped = events.withColumn("window_start", bucket(ts, interval))
    return exact_percentiles(stamped, latency, {"latency_ms": q}, ["window_start", *by])


def error_rates(events: DataFrame, by: Sequence[str] = (), *, interval: str = "1min", ts: str = "ts",
                pattern: str = "5..") -> DataFrame:
    """Errors per second and their share of all requests, from one aggregate."""
    errors, n = F.count_if(status_matches(F.col("status"), pattern)), F.count(F.lit(1))
    return events.groupBy(bucket(ts, interval).alias("window_start"), *by).agg(
        (errors / F.lit(float(interval_seconds(interval)))).alias("error_rate"),
        F.try_divide(errors, n).alias("error_ratio"))


def limited_hits(decisions: DataFrame, *, interval: str = "5min", ts: str = "ts") -> DataFrame:
    """Rejected requests per client and window."""
    return decisions.filter(~F.col("allowed")).groupBy(bucket(ts, interval).alias("window_start"), "client_id").agg(
        F.count(F.lit(1)).alias("hits"))


def action_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action_type", "scale_action").agg(F.count(F.lit(1)).alias("actions"))


def provisioning_stats(audit: DataFrame, column: str = "provisioning_latency_ms") -> DataFrame:
    """Whole-number mean, extremes and sample count of the positive latencies."""
    c = F.col(column).cast("long")
    return audit.filter(c > 0).select(c.alias("_c")).agg(
        F.expr("try_divide(sum(_c) - sum(_c) % count(1), count(1))").cast("long").alias("avg_ms"),
        F.min("_c").alias("min_ms"), F.max("_c").alias("max_ms"), F.count(F.lit(1)).alias("samples"))


def phase_summary(samples: DataFrame, phase: str = "phase", *, latency: str = "latency_ms", ts: str = "ts") -> DataFrame:
    """Per load phase: median and 95th percentile latency, server errors, replicas at both ends."""
    ends = samples.groupBy(phase).agg(
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.min_by("replicas", ts).alias("start_replicas"), F.max_by("replicas", ts).alias("end_replicas"))
    return null_safe_join(ends, exact_percentiles(samples, latency, {"p50": 0.5, "p95": 0.95}, [phase]), [phase], "left")


def replica_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """Total and running instances per service from JSON lines; unreadable lines are skipped."""
    v = F.col("_v")
    parsed = lines.select(F.explode(F.array(F.try_parse_json(value))).alias("_v"))  # parsed once per line
    service = F.coalesce(F.try_variant_get(v, "$.Service", "string"), F.lit(""))
    state = F.lower(F.coalesce(F.try_variant_get(v, "$.State", "string"), F.lit("")))
    return parsed.filter(v.isNotNull()).groupBy(service.alias("service")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "running").alias("running"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "x")
    stats = long.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    return stats.join(exact_percentiles(long, "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"]), "column")


def gauge_timeline(audit: DataFrame, columns: Sequence[str], *, ts: str = "timestamp", interval: str = "1min",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Last value per interval on a dense grid, carried forward through empty intervals."""
    keys = list(keys)
    last = audit.groupBy(*keys, bucket(ts, interval).alias("timestamp")).agg(
        F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]), ts).alias("_g"))
    grid = resample(last.withColumn("value", F.lit(1.0)), interval, "mean", keys=keys).select(*keys, "timestamp")
    out = null_safe_join(grid, last, [*keys, "timestamp"], "left", exact=["timestamp"]).withColumnRenamed("_g", "value")
    filled = handle_missing(out, "ffill", keys=keys)
    return filled.select(*keys, "timestamp", *[F.col(f"value.{c}").alias(c) for c in columns])


def band(value: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """Label of the highest band whose lower bound the value reaches."""
    out = None
    for low, label in bands:
        hit = F.lit(True) if low == float("-inf") else value >= low
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.when(value.isNotNull(), out)


def name_of(value: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out
