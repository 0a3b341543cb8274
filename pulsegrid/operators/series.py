"""Preparing univariate series: normalise, resample densely, repair, scale, fuse, align."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.calendar import interval_seconds
from pulsegrid.functions.numeric import clean_double, clip
from pulsegrid.operators.ordered import DAY, fill_from_neighbours, null_safe_join, over_blocks, row_index, time_index
from pulsegrid.session import materialise

MICROS = 1_000_000
OFFSET_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"
GRID_CHUNK = 1440
# Aggregation names a source may ask for; anything else means sum.
AGGREGATIONS = ("mean", "max", "min", "sum")


# Text forms of a time beside ISO 8601, with what tells them apart. Numbers are epoch seconds.
TIME_FORMS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "yyyy/M/d H:mm"), (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^(19|20)\d{2}(0[1-9]|1[0-2])([0-2]\d|3[01])$", "yyyyMMdd"), (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4} \d{1,2}:\d{2}$", "MMM d yyyy H:mm"), (r"^[A-Z][a-z]{2} \d{1,2} \d{4} \d{1,2}:\d{2}:\d{2}$", "MMM d yyyy H:mm:ss"),
)


def parse_time(text: Column, unit: str = "s") -> Column:
    """A text as a time: ISO 8601, one of ``TIME_FORMS``, or a number of epoch units; else NULL. A bare
    time of day is no time, as its day would be that of the run."""
    text = F.trim(text)
    micros = {"us": 1, "ms": 1_000, "s": MICROS}[unit]
    out = F.when(text.rlike(r"^\d{4}-\d{1,2}"), text.try_cast("timestamp"))
    for pattern, form in TIME_FORMS:
        out = out.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(form)))
    number = text.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return out.when(number, F.timestamp_micros((text.try_cast("double") * micros).try_cast("long")))


def normalise(df: DataFrame, ts: str = "timestamp", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, timestamp, value, aware)`` with unparseable or missing rows dropped. ``aware`` marks
    timestamps that carried their own offset."""
    text = isinstance(df.schema[ts].dataType, T.StringType)
    when = parse_time(F.col(ts)) if text else F.col(ts).try_cast("timestamp")
    aware = F.col(ts).rlike(OFFSET_SUFFIX) if text else F.lit(False)
    return df.select(*keys, when.alias("timestamp"), clean_double(F.col(value)).alias("value"),
                     F.coalesce(aware, F.lit(False)).alias("aware")).dropna(subset=["timestamp", "value"])


def localise(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Read naive timestamps as wall-clock time of ``tz``. An ambiguous hour maps to its first
    occurrence."""
    if "aware" not in df.columns:
        df = df.withColumn("aware", F.lit(False))
    utc = F.when(F.col("aware"), F.col("timestamp")).otherwise(F.to_utc_timestamp("timestamp", tz))
    return df.withColumn("timestamp", utc if tz != "UTC" else F.col("timestamp")).drop("aware")


def time_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Keep ``start <= ts <= end``; pushed into the scan where the source can."""
    kind = df.schema[ts].dataType.simpleString()
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(kind))
    return df


def multiply(df: DataFrame, factor: float = 1.0) -> DataFrame:
    return df if factor == 1.0 else df.withColumn("value", F.col("value") * F.lit(float(factor)))


def clip_values(df: DataFrame, lower: float | None = None, upper: float | None = None) -> DataFrame:
    if lower is None and upper is None:
        return df
    return df.withColumn("value", clip(F.col("value"), lower, upper))


def dense_grid(bounds: DataFrame, keys: Sequence[str], step: int, first: str = "_lo", last: str = "_hi") -> DataFrame:
    """All bins between two edges (microseconds), as ``(keys, bin, idx)``. Exploded in two levels so
    that no single row holds the whole span."""
    n = F.floor((F.col(last) - F.col(first)) / F.lit(step * MICROS))
    chunks = bounds.select(*keys, F.col(first).alias("_f"), n.alias("_n")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / GRID_CHUNK))))
    i = F.explode(F.sequence(F.col("_c") * GRID_CHUNK, F.least((F.col("_c") + 1) * GRID_CHUNK - 1, F.col("_n"))))
    return chunks.repartition(*keys, "_c").select(*keys, "_f", i.alias("idx")).select(
        *keys, (F.col("_f") + F.col("idx") * F.lit(step * MICROS)).alias("_bin"), "idx")


def _bins(df: DataFrame, interval: str, keys: Sequence[str], ts: str, value: str, dense: bool) -> DataFrame:
    """Sum, extremes, and counts of rows and values of every bin; ``_n`` and ``_k`` are NULL in an empty one.

    Values are first combined on the finest grid that nests in both the day and the interval, so
    what is shuffled and joined afterwards is one row per bin.
    """
    keys, step = list(keys), interval_seconds(interval)
    fine = math.gcd(step, DAY)
    micros = F.unix_micros(ts)
    grid = F.floor(micros / F.lit(fine * MICROS)) * F.lit(fine * MICROS)
    # one row per bin, written down: bounds and values both read it, the source is scanned once
    parts = materialise(df.groupBy(*keys, grid.alias("_bin")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_k"), F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")))
    bounds = parts.groupBy(*keys).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
    if fine != step:
        day = F.lit(DAY * MICROS)
        origin = F.floor(F.col("_lo") / day) * day
        width = F.lit(step * MICROS)

        def edge(c: str) -> Column:
            return F.col("_o") + F.floor((F.col(c) - F.col("_o")) / width) * width

        anchored = bounds.withColumn("_o", origin)
        anchor = anchored.select(*keys, "_o")
        # one anchor row per series; the partial sums joined to it are one row per fine bin
        joined = null_safe_join(parts, anchor, keys) if keys else parts.crossJoin(F.broadcast(anchor))
        parts = joined.groupBy(*keys, edge("_bin").alias("_bin")).agg(
            *[F.sum(c).alias(c) for c in ("_s", "_k", "_n")], F.min("_min").alias("_min"), F.max("_max").alias("_max"))
        bounds = anchored.select(*keys, edge("_lo").alias("_lo"), edge("_hi").alias("_hi"))
    return null_safe_join(dense_grid(bounds, keys, step), parts, [*keys, "_bin"], "left") if dense else parts


def resample(df: DataFrame, interval: str = "1min", agg: str = "sum", *, keys: Sequence[str] = (),
             ts: str = "timestamp", value: str = "value", dense: bool = True) -> DataFrame:
    """Left-closed bins labelled by their left edge, counted from midnight of the series' first day,
    with every bin between the first and the last. An empty bin is 0 for ``sum``, NULL otherwise.
    Adds ``idx``, the bin's position in the series.
    """
    result = {
        "sum": F.coalesce("_s", F.lit(0.0)),
        "mean": F.try_divide("_s", "_k"),
        "min": F.col("_min"),
        "max": F.col("_max"),
    }[agg if agg in AGGREGATIONS else "sum"]
    bins = _bins(df, interval, keys, ts, value, dense)
    return bins.select(*keys, F.timestamp_micros("_bin").alias("timestamp"), result.alias("value"),
                       *(["idx"] if dense else []))


def count_and_mean(df: DataFrame, interval: str, *, keys: Sequence[str] = (), ts: str = "timestamp", value: str = "value",
                   count: str = "count", mean: str = "mean") -> DataFrame:
    """Rows and mean value of every bin, from one scan and on one grid; an empty bin has 0 rows and no mean."""
    bins = _bins(df, interval, keys, ts, value, True)
    return bins.select(*keys, F.timestamp_micros("_bin").alias("timestamp"), F.coalesce("_n", F.lit(0)).alias(count),
                       F.try_divide("_s", "_k").alias(mean), "idx")


def handle_missing(df: DataFrame, policy: str = "drop", *, keys: Sequence[str] = ()) -> DataFrame:
    """``drop`` (also any unknown name), ``zero``, ``ffill`` (then backwards for a leading gap) or
    ``interpolate`` (linear between neighbours; a leading or trailing gap takes the nearest value)."""
    if policy == "zero":
        return df.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if policy not in ("ffill", "interpolate"):
        return df.dropna(subset=["value"])
    near = fill_from_neighbours(df, "value", keys=keys)
    pv, nv = F.col("_pv"), F.col("_nv")
    if policy == "ffill":
        filled = F.coalesce(pv, nv)
    else:
        at, before, after = (F.unix_micros(c) for c in ("timestamp", "_pt", "_nt"))
        share = F.coalesce(F.try_divide(at - before, after - before), F.lit(0.0))
        filled = F.when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(pv + (nv - pv) * share)
    return near.withColumn("value", filled).select(*df.columns)


def fuse(tagged: DataFrame, mode: str = "sum") -> DataFrame:
    """Combine ``(timestamp, value, weight)`` rows of all sources into one value per timestamp."""
    if mode == "weighted_mean":
        rate = F.sum(F.col("value") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-9))
    else:
        rate = F.sum("value")
    return tagged.groupBy("timestamp").agg(rate.alias("req_rate_1m"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def top_entities(df: DataFrame, entity: str, value: str, n: int = 500) -> DataFrame:
    """The ``n`` entities with the largest totals; ties go to the smaller key."""
    totals = df.groupBy(entity).agg(F.sum(value).alias("total"))
    return totals.orderBy(F.desc("total"), entity).limit(n)


def top_entity_series(df: DataFrame, entity: str, time: str, value: str, n: int = 500) -> DataFrame:
    """Sum per time step over the top entities (at most ``n`` rows, hence broadcast)."""
    top = F.broadcast(top_entities(df, entity, value, n).select(entity))
    return df.join(top, entity, "left_semi").groupBy(time).agg(F.sum(value).alias("value"))


def first_steps(df: DataFrame, time: str, n: int = 30) -> DataFrame:
    """The first ``n`` steps in time order."""
    return df.orderBy(time).limit(n)


def mean_fill(df: DataFrame, value: str = "value") -> DataFrame:
    """Replace missing values by the mean of the others (one scalar, joined back)."""
    mean = df.agg(F.avg(value).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def scale_min_max(df: DataFrame, value: str, low: float, high: float, *, eps: float = 0.0,
                  out: str | None = None) -> DataFrame:
    """Map the value range to ``[low, high]``; NULL for a constant column when ``eps`` is 0."""
    ends = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    scaled = F.lit(low) + F.try_divide(F.col(value) - F.col("_min"), F.col("_max") - F.col("_min") + F.lit(eps)) \
        * F.lit(high - low)
    return df.crossJoin(F.broadcast(ends)).withColumn(out or value, scaled).drop("_min", "_max")


def align_by_position(series: DataFrame, trace: DataFrame, value: str, *, order: Sequence[str],
                      idx: str = "idx") -> DataFrame:
    """Row i of ``trace`` (in ``order``) next to row i of the indexed series; a shorter trace starts
    over, a longer one is cut off."""
    numbered = row_index(trace.select(*order, value), order, "_t").select("_t", value)
    length = numbered.agg(F.count(F.lit(1)).alias("_len"))
    return (
        series.crossJoin(F.broadcast(length)).withColumn("_t", F.col(idx) % F.col("_len"))
        .join(numbered, "_t").drop("_t", "_len")
    )


# Shape of the day used to spread a daily total over its hours.
DIURNAL = [math.sin(math.pi * (h - 6) / 12) ** 2 + 0.2 for h in range(24)]


def spread_over_day(daily: DataFrame, day: str, value: str) -> DataFrame:
    """A daily total as 24 hourly values that add up to it."""
    total = sum(DIURNAL)
    hours = F.explode(F.array(*[
        F.struct(F.lit(h).alias("hour"), F.lit(w / total).alias("share")) for h, w in enumerate(DIURNAL)]))
    return daily.withColumn("_h", hours).select(
        (F.col(day).cast("timestamp") + F.make_dt_interval(hours=F.col("_h.hour"))).alias("timestamp"),
        (F.col(value) * F.col("_h.share")).alias("value"))


def upsample_linear(series: DataFrame, factor: int, value: str = "value", *, ts: str = "timestamp") -> DataFrame:
    """``factor`` points per input row, evenly spaced from the first row to the last, linearly
    interpolated. Each row expands the stretch up to its successor, so nothing is joined."""
    indexed = time_index(series, ts)
    count = indexed.agg(F.count(F.lit(1)).alias("_m"))
    ahead = over_blocks(indexed, {"_next": lambda w: F.lead(value, 1).over(w)}, leading=1)
    rows = ahead.crossJoin(F.broadcast(count))
    m1, n1 = F.col("_m") - 1, F.col("_m") * F.lit(factor) - 1
    # output i sits at i*m1/n1; row j owns the i with j <= i*m1/n1 < j+1
    # (a single row owns them all)
    m1 = F.greatest(m1, F.lit(1))
    start = F.ceil(F.col("idx") * n1 / m1)
    stop = F.when(F.col("_next").isNull(), n1).otherwise(F.ceil((F.col("idx") + 1) * n1 / m1) - 1)
    points = rows.withColumn("i", F.explode(F.sequence(start.cast("long"), stop.cast("long"))))
    share = F.coalesce(F.try_divide(F.col("i") * m1 - F.col("idx") * n1, n1), F.lit(0.0))
    return points.select("i", (F.col(value) + (F.coalesce("_next", value) - F.col(value)) * share).alias("value"))


def gaps(df: DataFrame, interval: str = "1min", ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Steps longer than twice the interval, as ``(keys, after, before, gap_seconds)``. Such a step leaves a whole
    bucket of the interval empty, so the first and last stamp of each bucket are enough: an aggregate, then
    a window over the buckets of a slice; a slice gets the end of the one before from a table of slices."""
    from pyspark.sql import Window as W

    keys, step = list(keys), interval_seconds(interval)
    bucket = F.floor(F.unix_micros(ts) / F.lit(step * MICROS))
    ends = df.filter(F.col(ts).isNotNull()).groupBy(*keys, bucket.alias("_bucket")).agg(F.min(ts).alias("before"), F.max(ts).alias("_last"))
    ends = materialise(ends.withColumn("_slice", F.floor(F.col("_bucket") / F.lit(max(1, DAY // step)))))
    slices = ends.groupBy(*keys, "_slice").agg(F.max("_last").alias("_end"))
    carry = slices.select(*keys, "_slice", F.lag("_end").over(W.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    own = W.partitionBy(*keys, "_slice").orderBy("_bucket")
    stepped = null_safe_join(ends.withColumn("after", F.lag("_last").over(own)), carry, [*keys, "_slice"]) \
        .withColumn("after", F.coalesce("after", "_carry"))
    seconds = (F.unix_micros("before") - F.unix_micros("after")) / F.lit(float(MICROS))
    return stepped.withColumn("gap_seconds", seconds).filter(F.col("gap_seconds") > 2 * step).select(*keys, "after", "before", "gap_seconds")
