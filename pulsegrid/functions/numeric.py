"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT = 1e-9


def clean_double(c: Column) -> Column:
    """Parse to double; anything unparseable or NaN is missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value, leaving NULL alone (``greatest``/``least`` would skip it)."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def correlation_from_sums(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Pearson correlation out of plain sums; 0 when either side is flat. The subtraction cancels on
    flat data, so a spread below ``FLAT`` of the raw second moment counts as none."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    flat = (vx <= F.lit(FLAT) * n * sxx) | (vy <= F.lit(FLAT) * n * syy)
    return F.when(flat | (n < 2), F.lit(0.0)).otherwise(
        F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


TIE_NUDGE = 1e-9


def q6(c: Column) -> Column:
    """Six decimals, no negative zero: the form results are compared in. Exact ties are nudged off,
    as engines break them differently."""
    return F.round(c + F.lit(TIE_NUDGE), 6) + F.lit(0.0)
