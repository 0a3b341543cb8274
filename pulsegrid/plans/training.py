"""From a fused series to the training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import calendar_features
from pulsegrid.functions.numeric import clip
from pulsegrid.operators import rolling as R
from pulsegrid.operators.ordered import fill_from_neighbours, null_safe_join, time_index
from pulsegrid.operators.quality import report
from pulsegrid.operators.quantiles import exact_median
from pulsegrid.operators.series import count_and_mean, fuse
from pulsegrid.schema import FEATURE_COLS, LABEL_COLS
from pulsegrid.session import materialise
from pulsegrid.sources.manifest import contributions, ingest, load_manifest
from pulsegrid.sources.sinks import write_report, write_training_table

# Surge factor and floor.
SURGE_FACTOR, SURGE_FLOOR = 3.0, 1.0


def with_scalars(df: DataFrame, scalars: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attach per-series scalars (one row per series)."""
    return null_safe_join(df, scalars, list(keys)) if keys else df.crossJoin(F.broadcast(scalars))


def surge_flags(df: DataFrame, rate: str = R.RATE, keys: Sequence[str] = ()) -> DataFrame:
    """1.0 where the rate exceeds max(1, 3 x median of the series)."""
    median = exact_median(df, rate, keys, "_median")
    limit = F.greatest(F.lit(SURGE_FLOOR), F.col("_median") * SURGE_FACTOR)
    return with_scalars(df, median, keys).withColumn("is_surge", (F.col(rate) > limit).cast("double")).drop("_median")


def future_rate(df: DataFrame, steps: int = 5, rate: str = R.RATE, keys: Sequence[str] = (),
                ts: str = "timestamp") -> DataFrame:
    """The rate ``steps`` rows ahead; the last rows take the final rate of the series."""
    led = R.apply(df, R.lead_value("_ahead", rate, steps), keys=keys)
    final = df.groupBy(*keys).agg(F.max_by(rate, ts).alias("_final"))
    return with_scalars(led, final, keys).withColumn(
        "future_req_rate_5m", F.coalesce("_ahead", "_final")).drop("_ahead", "_final")


def build_features(fused: DataFrame, *, keys: Sequence[str] = (), latency: str | None = None,
                   infra: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """The 26 features, both labels and the timestamp for a ``(timestamp, req_rate_1m)`` series.

    Latency and infrastructure come from real columns where given (``latency`` names one, ``infra``
    lists those present), else from fixed functions of the load.
    """
    keys = list(keys)
    # one row per bin, read by the scalars, the median and the frames: written down once instead of
    # going back to the raw data for each
    indexed = materialise(fused if "idx" in fused.columns else time_index(fused, keys=keys))
    scalars = indexed.groupBy(*keys).agg(
        F.max(R.RATE).alias("_top"), F.max_by(R.RATE, "timestamp").alias("_final"))
    scalars = null_safe_join(scalars, exact_median(indexed, R.RATE, keys, "_median"), keys, "left") if keys else \
        scalars.crossJoin(exact_median(indexed, R.RATE, keys, "_median"))
    r = F.col(R.RATE)
    load = F.coalesce(F.when(F.col("_top") > 0, F.try_divide(r, F.col("_top"))), F.lit(0.0))
    cpu = clip(F.lit(0.1) + F.lit(0.7) * load, 0.05, 0.99)
    proxies = {
        "cpu_util": cpu, "memory_pressure": cpu, "active_connections": F.greatest(r * 0.2, F.lit(1.0)),
        "cache_hit_ratio": F.lit(0.5), "replica_count": F.lit(1.0), "queue_depth": F.lit(0.0),
    }
    base = with_scalars(indexed, scalars, keys).withColumns({
        "_lat": F.col(latency) if latency else F.greatest(F.lit(10.0) + F.lit(90.0) * load, F.lit(1.0)),
        **{k: F.col(k).cast("double") if k in infra else v for k, v in proxies.items()},
    })
    featured = R.apply(
        base,
        R.rolling_mean({"req_rate_5m": 5, "req_rate_15m": 15, "req_rate_30m": 30}),
        R.rolling_std({"latency_std_5m": 5, "latency_std_15m": 15}, "_lat"),
        R.rolling_max({"req_max_5m": 5, "req_max_15m": 15}),
        R.ewma({"ewma_03": 0.3, "ewma_07": 0.7}, keys=keys),
        R.rate_of_change(),
        R.autocorrelation(keys=keys),
        R.lead_value("_ahead"),
        keys=keys, rows=rows)
    limit = F.greatest(F.lit(SURGE_FLOOR), F.col("_median") * SURGE_FACTOR)
    return featured.withColumns({
        **calendar_features(F.col("timestamp")),
        "future_req_rate_5m": F.coalesce("_ahead", "_final"),
        "is_surge": (r > limit).cast("double"),
    }).select(*keys, "timestamp", *FEATURE_COLS, *LABEL_COLS)


def second_features(events: DataFrame, *, key: str = "endpoint", ts: str = "ts", latency: str = "latency_ms",
                    rows: int | None = None) -> DataFrame:
    """Features of a dense series of seconds per endpoint: mean request counts, maxima and deviations of the latency over
    windows of one minute to half an hour. A second without requests keeps the last latency. A NULL endpoint is one too."""
    grid = count_and_mean(events, "1s", keys=[key], ts=ts, value=latency, count="req_count", mean="latency")
    near = fill_from_neighbours(grid, "latency", keys=[key])
    filled = near.withColumn("latency", F.coalesce("_pv", "_nv")).drop("_pv", "_pt", "_nv", "_nt")
    named = {k: f"{k // 60}m" for k in (60, 300, 900, 1800)}
    out = R.apply(
        filled,
        R.count_means({f"req_rate_{m}": k for k, m in named.items()}, "req_count"),
        R.wide_max({f"req_max_{named[k]}": k for k in (300, 900)}, "req_count", keys=[key]),
        R.wide_std({f"latency_std_{named[k]}": k for k in (300, 900)}, "latency", keys=[key]),
        keys=[key], rows=rows)
    cols = [c for c in out.columns if c.startswith(("req_rate", "req_max", "latency_std"))]
    return out.select(key, "timestamp", *[F.col(c).cast("double").alias(c) for c in cols])


def build_training_table(spark: SparkSession, manifest: str | dict) -> tuple[DataFrame, DataFrame]:
    """Manifest to ``(features and labels, quality report)``. Writes both where the manifest names
    paths; the report looks at the fused series."""
    cfg = load_manifest(manifest)
    tagged = materialise(ingest(spark, cfg))
    if tagged.isEmpty():
        raise RuntimeError("no source of the manifest has usable rows")
    fused = materialise(fuse(tagged, cfg.get("fusion_mode", "sum")))
    features = build_features(fused)
    quality = report(fused, contributions(tagged))
    if cfg.get("output_path"):
        write_training_table(features, cfg["output_path"])
    if cfg.get("quality_report_path"):
        write_report(quality, cfg["quality_report_path"])
    return features, quality
