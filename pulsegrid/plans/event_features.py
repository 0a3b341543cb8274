"""The 26-feature vector per request event, as window queries over pre-aggregated seconds.

Order of events within an endpoint is (epoch millisecond, event_id). Plan:

1. count events and keep the last latency per (endpoint, second) -- partial aggregation before the
   only shuffle of this step -- and write that table down;
2. run the 1/5/15/30-minute frames on those seconds, partitioned by (endpoint, time slice) with a
   30-minute halo, so that a hot endpoint spreads over as many tasks as it has slices;
3. join the frames back to the events on (endpoint, second) and rank the events inside the second;
   seconds with more than ``HOT_SECOND`` events are split by millisecond and id block first;
4. run the row frames (averages, change, autocorrelation of the rate) on blocks of consecutive
   events with a halo.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.calendar import calendar_features
from pulsegrid.functions.numeric import correlation_from_sums
from pulsegrid.operators.ordered import ewma_stages, null_safe_join, over_blocks, running_before
from pulsegrid.schema import FEATURE_COLS
from pulsegrid.session import materialise

# Trailing windows in seconds, and the rows of rate history kept.
RATE_WINDOWS = (60, 300, 900, 1800)
MAX_WINDOWS = (300, 900)
STD_WINDOWS = (300, 900)
HISTORY = 60
# What the stream reports for infrastructure it cannot observe.
INFRA_DEFAULTS = {
    "cpu_util": 0.45, "memory_pressure": 0.45, "active_connections": 1.0,
    "cache_hit_ratio": 0.5, "replica_count": 1.0, "queue_depth": 0.0,
}

SLICE = 21_600  # seconds per slice: at most this many rows per (endpoint, slice), plus the halo
HALO = max(RATE_WINDOWS) + 1
ID_BLOCK_BITS = 20
HOT_SECOND = 1 << ID_BLOCK_BITS


def with_second(events: DataFrame) -> DataFrame:
    """Adds ``ms`` (epoch milliseconds) and ``sec`` (epoch seconds) from ``ts``."""
    ms = F.unix_millis("ts")
    return events.withColumn("ms", ms).withColumn("sec", F.floor(ms / F.lit(1000)))


# Spreads milliseconds further apart than any two 64-bit ids: (ms, event_id) order as one number.
# Unlike a struct it fits a hash aggregate, so the events need no sort before the partial step.
ID_SPAN = Decimal(1 << 64)


def per_second(events: DataFrame) -> DataFrame:
    """Event count and last latency per (endpoint, second)."""
    order = (F.col("ms") % 1000).cast("decimal(4,0)") * F.lit(ID_SPAN) + F.col("event_id").cast("decimal(19,0)")
    return with_second(events).groupBy("endpoint", "sec").agg(
        F.count(F.lit(1)).alias("cnt"), F.max_by("latency_ms", order).alias("last_latency"))


def combine_seconds(fresh: DataFrame, carried: DataFrame | None) -> DataFrame:
    """Seconds of this run on top of those kept from earlier ones: ``cnt`` is the total, ``old`` the
    part that was there before; the newest latency wins."""
    if carried is None:
        return fresh.withColumn("old", F.lit(0).cast("long"))
    both = fresh.select("endpoint", "sec", "cnt", "last_latency", F.lit(1).alias("_new")).unionByName(
        carried.select("endpoint", "sec", "cnt", "last_latency", F.lit(0).alias("_new")))
    return both.groupBy("endpoint", "sec").agg(
        F.sum("cnt").alias("cnt"), F.max_by("last_latency", "_new").alias("last_latency"),
        F.coalesce(F.sum(F.when(F.col("_new") == 0, F.col("cnt"))), F.lit(0).cast("long")).alias("old"))


PANED = sorted({*MAX_WINDOWS, *STD_WINDOWS})


def _pane(sec: Column, n: int) -> Column:
    return F.floor(sec / F.lit(n - 1))


def _merge(parts: list[tuple[Column, Column]]) -> Column:
    """Moments and peak of disjoint stretches, each a ``(struct, whether it counts)``."""
    n, mean, m2, peak = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0).cast("long")
    for stretch, counts in parts:
        def part(field: str, empty: Column, stretch=stretch, counts=counts) -> Column:
            return F.coalesce(F.when(counts, stretch[field]), empty)

        k, avg = part("n", F.lit(0).cast("long")).cast("double"), part("mean", F.lit(0.0))
        d, total = avg - mean, n + k
        m2 = m2 + k * part("var", F.lit(0.0)) + F.coalesce(F.try_divide(d * d * n * k, total), F.lit(0.0))
        mean = mean + F.coalesce(F.try_divide(d * k, total), F.lit(0.0))
        n, peak = total, F.greatest(peak, part("peak", F.lit(0).cast("long")))
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), peak.alias("peak"))


def _frames(seconds: DataFrame) -> DataFrame:
    """For each second: totals, maxima and latency moments of the seconds before it.

    The frames leave out the bucket exactly ``w`` seconds back (it counts only for an event that
    falls exactly on a second); that bucket comes along as ``edge<w>`` and is added where due.
    ``events_before`` is the number of earlier events of the endpoint: a running count inside the
    slice plus the totals of earlier slices.

    All frames cost O(1) per row. Totals are differences of running counts. For maxima and moments,
    panes as long as the window are scanned forwards and backwards: the window is the rest of one
    pane, from its first second on, and the start of the next.
    """
    own = F.floor(F.col("sec") / SLICE)
    halo = F.floor((F.col("sec") + HALO) / SLICE)
    sliced = seconds.withColumn("_own", own).withColumn(
        "_slice", F.explode(F.array_distinct(F.array(own, halo)))).withColumns(
        {f"_pane{n}": _pane(F.col("sec"), n) for n in PANED})
    key = W.partitionBy("endpoint", "_slice")
    w = key.orderBy("sec")
    growing = (W.unboundedPreceding, 0)

    def scan(n: int, order: Column) -> Column:
        over = W.partitionBy("endpoint", "_slice", f"_pane{n}").orderBy(order).rowsBetween(*growing)
        return F.struct(
            F.col(f"_pane{n}").alias("pane"), F.count("last_latency").over(over).alias("n"),
            F.avg("last_latency").over(over).alias("mean"), F.var_pop("last_latency").over(over).alias("var"),
            F.max("cnt").over(over).alias("peak"))

    scanned = sliced.select(
        "*", F.sum("cnt").over(w.rowsBetween(*growing)).alias("_run"),
        F.sum(F.when(F.col("_own") == F.col("_slice"), F.col("cnt") - F.col("old")))
        .over(w.rowsBetween(*growing)).alias("_in"),
        *[scan(n, F.col("sec").asc()).alias(f"_head{n}") for n in PANED],
        *[scan(n, F.col("sec").desc()).alias(f"_rest{n}") for n in PANED])
    # what follows each row, so that the row just left of a window leads to the window's first row
    followed = scanned.select(
        "*", *[F.lead(f"_rest{n}", 1).over(w).alias(f"_next{n}") for n in PANED],
        *[F.first(f"_rest{n}").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"_first{n}")
          for n in PANED])
    reached = followed.select(
        "endpoint", "sec", "cnt", "old", "_own", "_slice", "_in", "_run", *[f"_first{n}" for n in PANED],
        *[F.lag(f"_head{n}", 1).over(w).alias(f"_before{n}") for n in PANED],
        *[F.last(F.struct("_run", *([F.col(f"_next{n}").alias("next")] if n in PANED else [])))
          .over(w.rangeBetween(W.unboundedPreceding, -n)).alias(f"_left{n}") for n in RATE_WINDOWS],
        *[F.max(F.struct("cnt", "last_latency")).over(w.rangeBetween(-n, -n)).alias(f"edge{n}")
          for n in RATE_WINDOWS]).filter(F.col("_slice") == F.col("_own"))

    def moments(n: int) -> Column:
        current = _pane(F.col("sec") - 1, n)
        head, left = F.col(f"_before{n}"), F.col(f"_left{n}")
        start = F.when(left.isNull(), F.col(f"_first{n}")).otherwise(left["next"])
        return _merge([(start, start["pane"] == current - 1), (head, head["pane"] == current)])

    totals = seconds.groupBy("endpoint", own.alias("_slice")).agg(F.sum(F.col("cnt") - F.col("old")).alias("_n"))
    carried = running_before(totals, ["endpoint"], ["_slice"], "_n", "_off").drop("_n")
    return null_safe_join(reached, carried, ["endpoint", "_slice"], exact=["_slice"]).select(
        "endpoint", "sec", "old",
        (F.col("_off") + F.col("_in") - (F.col("cnt") - F.col("old"))).alias("events_before"),
        *[(F.col("_run") - F.col("cnt") - F.coalesce(F.col(f"_left{n}._run"), F.lit(0))).alias(f"tot{n}")
          for n in RATE_WINDOWS],
        *[moments(n).alias(f"lat{n}") for n in PANED],
        *[f"edge{n}" for n in RATE_WINDOWS])


def _add_point(n: Column, mean: Column, m2: Column, x: Column) -> tuple[Column, Column, Column]:
    """Count, mean and squared deviations after one more value; NULL adds nothing."""
    k = n + 1.0
    d = x - mean
    return (F.when(x.isNull(), n).otherwise(k),
            F.when(x.isNull(), mean).otherwise(mean + d / k),
            F.when(x.isNull(), m2).otherwise(m2 + d * d * n / k))


def trailing_windows(events: DataFrame, *, carried: DataFrame | None = None, seconds: DataFrame | None = None,
                     hot_second: int = HOT_SECOND) -> DataFrame:
    """Per event: totals and per-second maxima of the trailing windows, latency deviation, and the
    event's 0-based position ``idx`` within its endpoint. ``carried`` holds the seconds of earlier
    events (see :func:`per_second`) when the events continue a stream.

    The per-second table is written down once: frames, offsets and the search for hot seconds all
    read it, and the events themselves are scanned twice in all.
    """
    stamped = with_second(events)
    seconds = materialise(per_second(events)) if seconds is None else seconds
    table = _frames(combine_seconds(seconds, carried))
    group = ["endpoint", "sec"]
    hot = seconds.filter(F.col("cnt") > hot_second).select("endpoint", "sec", F.lit(True).alias("_hot"))
    if hot.isEmpty():
        table = table.withColumn("_skip", F.lit(0).cast("long"))
    else:
        # at most (all events / hot_second) rows: bounded, hence safe to broadcast
        block = F.shiftright("event_id", ID_BLOCK_BITS)
        marked = null_safe_join(stamped, F.broadcast(hot), group, "left", exact=["sec"])
        parts = marked.filter("_hot").groupBy(*group, F.col("ms").alias("_ms"), block.alias("_blk")).agg(
            F.count(F.lit(1)).alias("_n"))
        parts = running_before(parts, group, ["_ms", "_blk"], "_n", "_skip").drop("_n")
        table = null_safe_join(table, parts, group, "left", exact=["sec"]).withColumns({
            c: F.coalesce(c, F.lit(v).cast("long")) for c, v in (("_ms", -1), ("_blk", -1), ("_skip", 0))})
        stamped = marked.withColumns({
            "_ms": F.when(F.col("_hot"), F.col("ms")).otherwise(F.lit(-1)),
            "_blk": F.when(F.col("_hot"), block).otherwise(F.lit(-1))})
        group = [*group, "_ms", "_blk"]

    rank = F.row_number().over(W.partitionBy(*group).orderBy("ms", "event_id"))
    ranked = null_safe_join(stamped.withColumn("_rn", rank), table, group, exact=[k for k in group if k not in ("endpoint", "_blk")])
    fresh = F.col("_skip") + F.col("_rn")
    rn = F.col("old") + fresh
    on_edge = F.col("ms") % 1000 == 0

    def edge(n: int, field: str) -> Column:
        return F.when(on_edge, F.col(f"edge{n}.{field}"))

    out = {f"total_{n}s": F.col(f"tot{n}") + F.coalesce(edge(n, "cnt"), F.lit(0)) + rn for n in RATE_WINDOWS}
    out |= {f"max_{n}s": F.greatest(F.col(f"lat{n}.peak"), edge(n, "cnt"), rn) for n in MAX_WINDOWS}
    for n in STD_WINDOWS:
        k, mean, m2 = (F.col(f"lat{n}.{f}") for f in ("n", "mean", "m2"))
        k, mean, m2 = _add_point(k, mean, m2, edge(n, "last_latency"))
        k, _, m2 = _add_point(k, mean, m2, F.col("latency_ms"))
        out[f"latency_std_{n}s"] = F.when(k < 2, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(m2, k - 1)))
    return ranked.select(*events.columns, "ms", (F.col("events_before") + fresh - 1).alias("idx"),
                         *[c.alias(k) for k, c in out.items()])


def rates(windows: DataFrame) -> DataFrame:
    """Requests per second with the fixed window lengths as divisors."""
    named = {"req_rate_1m": 60, "req_rate_5m": 300, "req_rate_15m": 900, "req_rate_30m": 1800}
    return windows.withColumns({k: F.col(f"total_{n}s") / F.lit(float(n)) for k, n in named.items()})


_SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def _rate_stages(rate: str, count: str) -> list[dict]:
    """Previous rate, and the sums of the last ``HISTORY - 1`` (count, previous count) pairs as
    differences of running sums. Counts are whole numbers taken relative to one of their block, so
    the differences are exact."""
    pairs = HISTORY - 1
    x, y, paired = F.col("_x"), F.col("_y"), F.col("_y").isNotNull()

    def running(w):
        return w.rowsBetween(W.unboundedPreceding, 0)

    levels = {"_mid": lambda w: F.first(count).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))}
    first = {
        "_prev": lambda w: F.lag(rate, 1).over(w),
        "_y": lambda w: (F.lag(count, 1).over(w) - F.col("_mid")).cast("double"),
        "_x": lambda w: (F.col(count) - F.col("_mid")).cast("double"),
    }
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x, "syy": y * y}
    second = {"_run": lambda w: F.struct(
        *[F.coalesce(F.sum(F.when(paired, t)).over(running(w)), F.lit(0.0)).alias(k) for k, t in terms.items()])}
    third = {"_left": lambda w: F.lag("_run", pairs).over(w)}
    return [levels, first, second, third]


KEPT_RATES = 256  # rates per endpoint a later run needs to continue averages and autocorrelation


def rate_history(rated: DataFrame, rate: str = "req_rate_1m", count: str = "total_60s", *,
                 history: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Per event, over the endpoint's earlier events: both averages, change, autocorrelation.

    The autocorrelation is taken on the whole-number counts behind the rates: same value, and sums
    of whole numbers are exact, so a flat history is recognised as flat. ``history`` holds the last
    ``KEPT_RATES`` rates of earlier events (``endpoint, seq`` and the two columns); with it, ``seq``
    numbers the events onwards.
    """
    series = rated.withColumn("seq", F.col("idx"))
    if history is not None:
        ends = history.groupBy("endpoint").agg(F.min("seq").alias("_lo"), (F.max("seq") + 1).alias("_next"))
        shifted = null_safe_join(series, ends, ["endpoint"], "left").withColumns({
            "seq": F.col("idx") + F.coalesce("_next", F.lit(0)),
            "idx": F.col("idx") + F.coalesce(F.col("_next") - F.col("_lo"), F.lit(0)), "_old": F.lit(False),
        }).drop("_lo", "_next")
        older = null_safe_join(history, ends, ["endpoint"]).select(
            "endpoint", "seq", rate, count, (F.col("seq") - F.col("_lo")).alias("idx"), F.lit(True).alias("_old"))
        series = shifted.unionByName(older, allowMissingColumns=True)
    averages, reach, helpers = ewma_stages(F.col(rate), {"ewma_03": 0.3, "ewma_07": 0.7}, keys=["endpoint"])
    out = over_blocks(series, *_rate_stages(rate, count), *averages, keys=["endpoint"],
                      trailing=max(reach, HISTORY), rows=rows)
    if history is not None:
        out = out.filter(~F.col("_old")).drop("_old")
    prev = F.coalesce("_prev", F.lit(0.0))
    sums = [F.col(f"_run.{c}") - F.coalesce(F.col(f"_left.{c}"), F.lit(0.0)) for c in _SUMS]
    return out.withColumns({
        "rate_of_change": (F.col(rate) - prev) / F.greatest(prev, F.lit(1.0)),
        "autocorr_lag1": correlation_from_sums(*sums),
    }).drop(*helpers, "_mid", "_prev", "_x", "_y", "_run", "_left")


def feature_vectors(events: DataFrame, *, infra: dict[str, float] | None = None, carried: DataFrame | None = None,
                    history: DataFrame | None = None, seconds: DataFrame | None = None, extra: Sequence[str] = (),
                    hot_second: int = HOT_SECOND, rows: int | None = None) -> DataFrame:
    """One feature vector per event: ``event_id, endpoint, timestamp`` and the 26 features."""
    windows = rates(trailing_windows(
        events.select("event_id", "ts", "endpoint", "latency_ms"), carried=carried, seconds=seconds,
        hot_second=hot_second))
    full = rate_history(windows, history=history, rows=rows)
    renamed = {
        "latency_std_5m": F.col("latency_std_300s"), "latency_std_15m": F.col("latency_std_900s"),
        "req_max_5m": F.col("max_300s").cast("double"), "req_max_15m": F.col("max_900s").cast("double"),
    }
    constants = {k: F.lit(float(v)) for k, v in {**INFRA_DEFAULTS, **(infra or {})}.items()}
    ready = full.withColumns({**renamed, **constants, **calendar_features(F.col("ts"), monday=1)})
    return ready.select("event_id", "endpoint", F.timestamp_millis("ms").alias("timestamp"), *FEATURE_COLS, *extra)


def with_infra(events: DataFrame, per_minute: DataFrame | None = None, *, ts: str = "ts",
               defaults: dict[str, float] | None = None) -> DataFrame:
    """Attach infrastructure columns: constants, or measurements joined on (endpoint, minute)."""
    defaults = {**INFRA_DEFAULTS, **(defaults or {})}
    if per_minute is None:
        return events.withColumns({k: F.lit(float(v)) for k, v in defaults.items()})
    given = [c for c in per_minute.columns if c in defaults]
    joined = null_safe_join(events.withColumn("minute", F.date_trunc("minute", ts)), per_minute.select("endpoint", "minute", *given),
                            ["endpoint", "minute"], "left").drop("minute")
    return joined.withColumns({
        k: F.coalesce(F.col(k).cast("double"), F.lit(float(v))) if k in given else F.lit(float(v))
        for k, v in defaults.items()})
