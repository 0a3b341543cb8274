"""Data-quality report of a series, part by part and as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ordered import row_index
from pulsegrid.operators.rolling import outlier_ratio
from pulsegrid.operators.series import gaps
from pulsegrid.session import materialise

GAP_LIST = 20


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)).cast("long"))


def _span_days() -> Column:
    span = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(86_400_000_000.0)
    return F.coalesce(F.round(span, 2), F.lit(0.0))


def date_range(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(F.min(ts).alias("start"), F.max(ts).alias("end")).withColumn("span_days", _span_days())


def _overview(df: DataFrame, ts: str) -> DataFrame:
    """Shape, date range and columns with missing values, from one aggregate."""
    fields = df.schema.fields
    counted = [F.count_if(_missing(f)).alias(f"_nulls_{k}") for k, f in enumerate(fields)]
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), F.min(ts).alias("start"), F.max(ts).alias("end"), *counted)
    nulls = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"_nulls_{k}").alias("nulls")) for k, f in enumerate(fields)])
    return one.select("total_rows", F.lit(len(fields)).cast("long").alias("total_columns"), "start", "end", _span_days().alias("span_days"),
                      F.sort_array(F.filter(nulls, lambda c: c["nulls"] > 0)).alias("null_counts"))


def duplicates(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows minus distinct timestamps, a missing one counting as one value."""
    per_stamp = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    return per_stamp.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_timestamps"))


def source_shares(contributions: DataFrame) -> DataFrame:
    """Rows and percentage per source."""
    total = contributions.agg(F.sum("rows").alias("_t"))
    share = F.round(F.lit(100.0) * F.col("rows") / F.greatest(F.coalesce("_t", F.lit(1)), F.lit(1)), 2)
    return contributions.crossJoin(F.broadcast(total)).select("source", "rows", share.alias("percent"))


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls)`` for columns with missing values, NaN included; one pass."""
    names = [f.name for f in df.schema.fields]
    counted = df.agg(*[F.count_if(_missing(f)).alias(f.name) for f in df.schema.fields])
    return counted.unpivot([], [F.col(f"`{n}`") for n in names], "column", "nulls").filter("nulls > 0")


def gap_summary(gap_rows: DataFrame) -> DataFrame:
    return gap_rows.agg(F.count(F.lit(1)).alias("total_gaps"),
                        F.coalesce(F.round(F.max("gap_seconds"), 1), F.lit(0.0)).alias("max_gap_seconds"))


def first_gaps(gap_rows: DataFrame, n: int = GAP_LIST) -> DataFrame:
    return gap_rows.orderBy("before").limit(n)


def series_outlier_ratio(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Ratio on ``req_rate_1m``, else ``value``, else 0; rows of one timestamp are taken in the order of their values, NULL first."""
    column = next((c for c in ("req_rate_1m", "value") if c in df.columns), None)
    if column is None:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("outlier_ratio"))
    return outlier_ratio(df if "idx" in df.columns else row_index(df, [ts, column]), column)


def report(df: DataFrame, contributions: DataFrame, *, interval: str = "1min", ts: str = "timestamp") -> DataFrame:
    """Everything above as one nested row. Only bounded lists are collected into it: at most twenty
    gaps, one entry per source and per column."""
    gap_rows = materialise(gaps(df, interval, ts))  # read twice
    listed = first_gaps(gap_rows).agg(F.sort_array(F.collect_list(F.struct(
        F.col("before"), F.col("after"), F.round("gap_seconds", 1).alias("gap_seconds")))).alias("_gaps"))
    shares = source_shares(contributions).agg(F.sort_array(F.collect_list(
        F.struct("source", "rows", "percent"))).alias("source_contributions"))
    parts = [_overview(df, ts), gap_summary(gap_rows), listed, duplicates(df, ts), series_outlier_ratio(df, ts), shares]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # single rows
    return one.select(
        "total_rows", "total_columns",
        F.struct("start", "end", "span_days").alias("date_range"),
        F.struct("total_gaps", "max_gap_seconds", F.col("_gaps").alias("gaps")).alias("timestamp_continuity"),
        "duplicate_timestamps", "outlier_ratio", "source_contributions", "null_counts",
        (F.size("null_counts") == 0).alias("null_free"))
