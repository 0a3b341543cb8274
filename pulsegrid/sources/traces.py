"""File sources for public workload traces.

A source is a function ``(spark, cfg) -> DataFrame(timestamp, value)``; the registry maps the names
used in a manifest to them. Delimited files are read as text columns without schema inference (one
pass), and only the two resolved columns are selected. A missing file, format or column gives an
empty frame.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import series as S
from pulsegrid.schema import SERIES
from pulsegrid.session import use_utc

Config = Mapping[str, Any]

# Column names tried, in order, when the configured ones are absent.
FUNCTION_COLUMNS = (
    ("end_timestamp", "timestamp", "Timestamp", "time"),
    ("invocations", "Invocations", "count", "Count"))
VM_COLUMNS = (
    ("timestamp_vm", "timestamp", "Timestamp", "time"),
    ("avg_cpu", "max_cpu", "cpu_utilization", "vm_utilization"))
GOOGLE_COLUMNS = (
    ("start_time", "start", "timestamp", "time", "start_time_us"),
    ("avg_cpu", "average_usage.cpus", "cpu_usage", "mean_cpu_usage_rate"))
ALIBABA_COLUMNS = (
    ("time_stamp", "timestamp", "ts", "start_time", "time"),
    ("cpu_util_percent", "request_count", "cpu_usage", "mem_util_percent", "latency"))
# Lower bounds of epoch numbers per unit.
EPOCH_BOUNDS = {"us": 1e15, "ms": 1e12, "s": 1e9}
# File suffixes and their separators.
SEPARATORS = {".csv": ",", ".txt": ",", ".tsv": "\t"}
# Access-log time stamp, and the hour a dump file falls back to.
LOG_STAMP, LOG_FORMAT = r"\[([^\]]+)\]", "dd/MMM/yyyy:HH:mm:ss Z"
DUMP_NAME = r"(?:^|[/=])(?:pageviews-)?(\d{8})[^-/]*-(\d{2})[^/]*(?:/part-[^/]*)?$"
DUMP_FALLBACK = "2024-01-01 00:00:00"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SERIES)


def read_columns(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns of a parquet or delimited file or folder; None if absent or of another kind."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    try:
        if suffix == ".parquet":
            return spark.read.parquet(path)
        if suffix in SEPARATORS:
            return spark.read.csv(path, sep=SEPARATORS[suffix], header=True)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return None


def resolve(columns: Sequence[str], ts: str, value: str,
            aliases: tuple[Sequence[str], Sequence[str]] | None = None) -> tuple[str, str] | None:
    """The two columns to use: the configured pair, else the first alias present for each."""
    if aliases and not (ts in columns and value in columns):
        ts = next((c for c in aliases[0] if c in columns), ts)
        value = next((c for c in aliases[1] if c in columns), value)
    return (ts, value) if ts in columns and value in columns else None


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _two_columns(spark, cfg: Config, ts: str, value: str, aliases=None) -> DataFrame | None:
    raw = read_columns(spark, cfg["path"])
    if raw is None:
        return None
    found = resolve(raw.columns, cfg.get("timestamp_col", ts), cfg.get("value_col", value), aliases)
    if found is None:
        return None
    return raw.select(_quoted(found[0]).alias("timestamp"), _quoted(found[1]).alias("value"))


def _stamped(spark: SparkSession, df: DataFrame | None, cfg: Config) -> DataFrame:
    """Numeric stamps in the configured ``epoch_unit``; without one the text forms of a time apply."""
    if df is None:
        return empty(spark)
    return epoch_or_text(df, (), cfg["epoch_unit"]) if cfg.get("epoch_unit") else df


def delimited(spark: SparkSession, cfg: Config) -> DataFrame:
    return _stamped(spark, _two_columns(spark, cfg, "timestamp", "value"), cfg)


def function_invocations(spark: SparkSession, cfg: Config) -> DataFrame:
    return _stamped(spark, _two_columns(spark, cfg, "end_timestamp", "invocations", FUNCTION_COLUMNS), cfg)


def vm_utilisation(spark: SparkSession, cfg: Config) -> DataFrame:
    return _stamped(spark, _two_columns(spark, cfg, "timestamp_vm", "avg_cpu", VM_COLUMNS), cfg)


def epoch_or_text(df: DataFrame, units: Sequence[str], unit: str | None = None) -> DataFrame:
    """Turn ``timestamp`` into an instant. The unit of numeric stamps follows from the size of their
    median (a sketch, one scalar joined back); pass ``unit`` where stamps are relative."""
    number = F.col("timestamp").try_cast("double")
    micros = {"us": 1, "ms": 1_000, "s": 1_000_000}
    text = S.parse_time(F.col("timestamp").cast("string"))

    def at(u: str) -> Column:
        return F.timestamp_micros((number * micros[u]).try_cast("long"))

    if unit:
        return df.withColumn("timestamp", at(unit))
    middle = df.agg(F.percentile_approx(number, 0.5).alias("_mid"))
    chosen = text
    for u in sorted(units, key=lambda u: EPOCH_BOUNDS[u]):
        chosen = F.when(F.col("_mid") > EPOCH_BOUNDS[u], at(u)).otherwise(chosen)
    return df.crossJoin(F.broadcast(middle)).withColumn("timestamp", chosen).drop("_mid")


def google_cluster(spark: SparkSession, cfg: Config) -> DataFrame:
    df = _two_columns(spark, cfg, "start_time", "avg_cpu", GOOGLE_COLUMNS)
    return empty(spark) if df is None else epoch_or_text(df, ("us", "ms", "s"), cfg.get("epoch_unit"))


def alibaba_cluster(spark: SparkSession, cfg: Config) -> DataFrame:
    df = _two_columns(spark, cfg, "time_stamp", "cpu_util_percent", ALIBABA_COLUMNS)
    return empty(spark) if df is None else epoch_or_text(df, ("s",), cfg.get("epoch_unit"))


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def access_log_minutes(lines: DataFrame) -> DataFrame:
    """Requests per UTC minute; lines without a readable stamp are skipped."""
    stamp = F.try_to_timestamp(F.regexp_extract("value", LOG_STAMP, 1), F.lit(LOG_FORMAT))
    minutes = lines.select(F.date_trunc("minute", stamp).alias("timestamp")).filter(F.col("timestamp").isNotNull())
    return minutes.groupBy("timestamp").agg(F.count(F.lit(1)).cast("double").alias("value"))


def access_log(spark: SparkSession, cfg: Config) -> DataFrame:
    lines = _lines(spark, cfg["path"])
    return empty(spark) if lines is None else access_log_minutes(lines)


def pageview_dump(spark: SparkSession, cfg: Config) -> DataFrame:
    """One row per dump file: its hour (from the name) and the sum of its views. The view count is
    the fourth of five or more fields, the third of three or four."""
    lines = _lines(spark, cfg["path"])
    if lines is None:
        return empty(spark)
    parts = F.split("value", " ")
    views = F.when(F.size(parts) >= 5, parts[3]).when(F.size(parts) >= 3, parts[2])
    file = F.col("_metadata.file_path")
    day, hour = (F.regexp_extract(file, DUMP_NAME, i) for i in (1, 2))
    stamp = F.when(day == "", F.lit(DUMP_FALLBACK).cast("timestamp")).otherwise(
        F.try_to_timestamp(F.concat(day, hour), F.lit("yyyyMMddHH")))
    return lines.select(stamp.alias("timestamp"), views.try_cast("double").alias("v")).groupBy("timestamp").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("value")).filter(F.col("timestamp").isNotNull())


def pageviews(spark: SparkSession, cfg: Config) -> DataFrame:
    """Pre-aggregated ``timestamp, views`` tables, or raw dumps (.gz, .txt)."""
    suffix = os.path.splitext(cfg["path"].rstrip("/"))[1].lower()
    if suffix in (".gz", ".txt"):
        return pageview_dump(spark, cfg)
    if suffix not in (".csv", ".parquet"):
        return empty(spark)
    return _stamped(spark, _two_columns(spark, cfg, "timestamp", "views"), cfg)


def page_day_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide table (first column the page, one column per day) as ``(page, day, views)``."""
    raw = read_columns(spark, path)
    if raw is None:
        return spark.createDataFrame([], "page string, day date, views double")
    page, *days = raw.columns
    return raw.select(_quoted(page).alias("page"), *[_quoted(d).try_cast("double").alias(d) for d in days]).unpivot(
        "page", [_quoted(d) for d in days], "day", "views").withColumn("day", F.col("day").try_cast("date"))


# The names a manifest may use.
REGISTRY: dict[str, Callable[[SparkSession, Config], DataFrame]] = {
    "wikimedia": pageviews,
    "wikimedia_pageviews": pageviews,
    "azure_functions": function_invocations,
    "azure_vm": vm_utilisation,
    "google_cluster": google_cluster,
    "google_cluster_2019": google_cluster,
    "alibaba": alibaba_cluster,
    "alibaba_cluster": alibaba_cluster,
    "apache_access": access_log,
    "nasa_http": access_log,
    "apache_log": access_log,
    "generic": delimited,
}


def register(name: str, source: Callable[[SparkSession, Config], DataFrame]) -> None:
    REGISTRY[name] = source


def load_series(spark: SparkSession, cfg: Config) -> DataFrame:
    """Read and prepare one configured source: normalise, to UTC, range, resample, multiply, clip,
    repair."""
    use_utc(spark)
    raw = REGISTRY.get(cfg.get("adapter", "generic"), delimited)(spark, cfg)
    df = S.localise(S.normalise(raw), cfg.get("timezone") or "UTC")
    df = S.time_range(df, cfg.get("filter_start"), cfg.get("filter_end"))
    df = S.resample(df, cfg.get("resample", "1min"), cfg.get("agg", "sum")).drop("idx")
    df = S.multiply(df, float(cfg.get("multiplier", 1.0)))
    df = S.clip_values(df, cfg.get("clip_min"), cfg.get("clip_max"))
    return S.handle_missing(df, cfg.get("missing_data_policy", "drop"))
