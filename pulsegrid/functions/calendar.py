"""Calendar encodings and time bins (UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval suffixes as the source configurations write them.
UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1,
    "min": 60, "t": 60, "minute": 60,
    "h": 3600, "hour": 3600,
    "d": 86_400, "day": 86_400,
    "w": 604_800, "week": 604_800,
}


def interval_seconds(text: str) -> int:
    """``"1min"``, ``"5 minutes"``, ``"h"`` -> seconds."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    unit = m.group(2).lower()
    if unit not in UNIT_SECONDS and unit.endswith("s"):
        unit = unit[:-1]
    if unit not in UNIT_SECONDS:
        raise ValueError(f"not an interval: {text!r}")
    return int(m.group(1) or 1) * UNIT_SECONDS[unit]


def _cycle(value: Column, length: float) -> tuple[Column, Column]:
    angle = value * F.lit(2.0) * F.pi() / F.lit(length)
    return F.sin(angle), F.cos(angle)


def calendar_features(ts: Column, *, monday: int = 0) -> dict[str, Column]:
    """The eight calendar features. The batch tables number Monday 0, the event stream Monday 1,
    which gives different day-of-week angles; callers choose."""
    hour_sin, hour_cos = _cycle(F.hour(ts), 24.0)
    dow_sin, dow_cos = _cycle(F.weekday(ts) + F.lit(monday), 7.0)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
        "week_of_year": F.weekofyear(ts).cast("double"),
        "is_weekend": (F.weekday(ts) >= 5).cast("double"),
        "is_holiday": F.lit(0.0),
        "day_of_month": F.dayofmonth(ts).cast("double"),
    }


def bin_start(ts: Column, origin: Column, seconds: int) -> Column:
    """Left edge of the bin of ``ts`` when bins are counted from ``origin``."""
    step = F.lit(seconds * 1_000_000)
    return F.timestamp_micros(
        F.unix_micros(origin) + F.floor((F.unix_micros(ts) - F.unix_micros(origin)) / step) * step)
