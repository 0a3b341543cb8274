"""Newest-record queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.schema import FEATURE_COLS
from pulsegrid.sources.sinks import since_newest


def latest_actions(audit: DataFrame, n: int = 50, *, ts: str = "timestamp", tie: Sequence[str] = ("service",)) -> DataFrame:
    """The ``n`` newest actions (a top-n, not a full sort)."""
    return audit.orderBy(F.desc(ts), *tie).limit(n)


def latest_status(audit: DataFrame, *, ts: str = "timestamp", tie: Sequence[str] = ("service",)) -> DataFrame:
    """The newest action as one row."""
    row = F.struct(*audit.columns)
    newest = audit.agg(F.max_by(row, F.struct(ts, *tie)).alias("_r"))
    return newest.filter(F.col("_r").isNotNull()).select("_r.*")


def _recent(points: DataFrame, as_of: str | None, minutes: int, ts: str) -> DataFrame:
    """Points of the trailing window; ``as_of`` defaults to the newest point."""
    if as_of is not None:
        end = F.lit(as_of).cast("timestamp")
        return points.filter((F.col(ts) > end - F.make_dt_interval(mins=F.lit(minutes))) & (F.col(ts) <= end))
    points = since_newest(points, 1 + minutes // 1440)
    newest = points.agg(F.max(ts).alias("_end"))
    return points.crossJoin(F.broadcast(newest)).filter(
        F.col(ts) > F.col("_end") - F.make_dt_interval(mins=F.lit(minutes))).drop("_end")


def latest_vector(long_points: DataFrame, *, as_of: str | None = None, minutes: int = 3,
                  ts: str = "timestamp", fields: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """Last value of every field in the trailing minutes, one wide row per endpoint. Input is
    ``(endpoint, timestamp, field, value)``."""
    recent = _recent(long_points, as_of, minutes, ts)
    last = recent.groupBy("endpoint", "field").agg(F.max_by("value", ts).alias("value"))
    return last.groupBy("endpoint").pivot("field", list(fields)).agg(F.max("value"))


def latest_field_percent(points: DataFrame, field: str, *, as_of: str | None = None, minutes: int = 5,
                         ts: str = "timestamp", by: Sequence[str] = ("endpoint",),
                         tie: Sequence[str] = ()) -> DataFrame:
    """Newest value of one field in the trailing minutes, as a percentage."""
    recent = _recent(points, as_of, minutes, ts)
    return recent.groupBy(*by).agg((F.max_by(field, F.struct(ts, *tie)) * 100.0).alias("percent"))
