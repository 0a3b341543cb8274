"""Row-window features of an indexed series: one row per (keys, idx), value in ``req_rate_1m``.

Every feature is a set of stages for :func:`over_blocks`; :func:`apply` runs several of them in one
pass over the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import ewma_stages, over_blocks

RATE = "req_rate_1m"


@dataclass
class Feature:
    """Stages plus how far their frames reach."""

    stages: list[dict]
    trailing: int = 0
    leading: int = 0
    helpers: list[str] = field(default_factory=list)


def _rows(expr: Column, n: int):
    return lambda w: expr.over(w.rowsBetween(-(n - 1), 0))


def rolling_mean(sizes: dict[str, int], value: str = RATE) -> Feature:
    return Feature([{k: _rows(F.avg(value), n) for k, n in sizes.items()}], max(sizes.values()))


def rolling_max(sizes: dict[str, int], value: str = RATE) -> Feature:
    return Feature([{k: _rows(F.max(value), n) for k, n in sizes.items()}], max(sizes.values()))


def rolling_std(sizes: dict[str, int], value: str) -> Feature:
    """Sample deviation; 0 while there is only one row."""
    def std(n):
        return lambda w: F.coalesce(F.stddev_samp(value).over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0))

    return Feature([{k: std(n) for k, n in sizes.items()}], max(sizes.values()))


def ewma(alphas: dict[str, float], value: str = RATE, *, keys: Sequence[str] = (), adjust: bool = False) -> Feature:
    stages, reach, helpers = ewma_stages(F.col(value), alphas, keys=keys, adjust=adjust)
    return Feature(stages, reach, helpers=helpers)


def rate_of_change(name: str = "rate_of_change", value: str = RATE) -> Feature:
    """(x - previous) / max(previous, 1); 0 for the first row."""
    def change(w):
        prev = F.coalesce(F.lag(value, 1).over(w), F.col(value))
        return (F.col(value) - prev) / F.greatest(prev, F.lit(1.0))

    return Feature([{name: change}], 1)


def autocorrelation(name: str = "autocorr_lag1", value: str = RATE, *, pairs: int = 60,
                    full: bool = False, keys: Sequence[str] = ()) -> Feature:
    """Lag-1 correlation over the last ``pairs`` pairs; 0 with fewer than two (or, when ``full``,
    than all) of them, and 0 for a flat stretch. Moments are taken about the means of two panes and merged: O(1) per row for any
    number of pairs, and the level of the series doesn't matter."""
    x, y = F.col("_ac_x"), F.col("_ac_y")
    first = {"_ac_y": lambda w: F.lag(value, 1).over(w),
             "_ac_x": lambda w: F.when(F.lag(value, 1).over(w).isNotNull(), F.col(value))}
    moments = {"n": F.count(y), "mx": F.avg(x), "my": F.avg(y), "c": F.covar_pop(x, y), "vx": F.var_pop(x), "vy": F.var_pop(y),
               "x0": F.min(x), "x1": F.max(x), "y0": F.min(y), "y1": F.max(y)}

    def merge(new, old, joined):
        was = {k: F.when(joined, old[k]) for k in moments}
        na, nb = (F.coalesce(s["n"], F.lit(0)).cast("double") for s in (new, was))
        n, share = na + nb, F.coalesce(F.try_divide(na * nb, na + nb), F.lit(0.0))
        dx, dy = (F.coalesce(was[m] - new[m], F.lit(0.0)) for m in ("mx", "my"))
        c, vx, vy = (na * F.coalesce(new[k], F.lit(0.0)) + nb * F.coalesce(was[k], F.lit(0.0)) + d * share
                     for k, d in (("c", dx * dy), ("vx", dx * dx), ("vy", dy * dy)))
        varies = (n >= (pairs if full else 2)) & (n >= 2)
        for axis in "xy":
            varies = varies & (F.greatest(new[axis + "1"], was[axis + "1"]) > F.least(new[axis + "0"], was[axis + "0"]))
        r = F.try_divide(c, F.sqrt(vx) * F.sqrt(vy))
        return F.when(varies, F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))

    panes = _paned({name: pairs}, keys, moments, merge)
    return Feature([first, *panes.stages], pairs + 1, helpers=["_ac_x", "_ac_y", *panes.helpers])


def lead_value(name: str = "future", value: str = RATE, steps: int = 5) -> Feature:
    return Feature([{name: lambda w: F.lead(value, steps).over(w)}], leading=steps)


def future_mean(name: str = "future", value: str = RATE, rows: int = 300, *, keys: Sequence[str] = ()) -> Feature:
    """Mean of the next ``rows`` rows; NULL where fewer are left. The mean of the rows up to each row, merged from two panes, is
    looked up ``rows`` rows ahead: O(1) per row."""
    def merge(new, old, joined):
        before = F.when(joined, old["s"])
        total = F.coalesce(new["s"] + before, new["s"], before)
        return F.try_divide(total, new["n"] + F.coalesce(F.when(joined, old["n"]), F.lit(0)))

    trailing = f"_{name}_trailing"
    panes = _paned({trailing: rows}, keys, {"n": F.count(value), "s": F.sum(value)}, merge)
    ahead = {name: lambda w: F.lead(trailing, rows).over(w)}
    return Feature([*panes.stages, ahead], leading=rows, helpers=[trailing, *panes.helpers])


def count_means(sizes: dict[str, int], value: str) -> Feature:
    """Rolling means of whole-number counts through one running sum: O(1) per row for any size."""
    run = {"_run": lambda w: F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))}

    def mean(n):
        def over(w):
            total = F.col("_run") - F.coalesce(F.lag("_run", n).over(w), F.lit(0))
            return total / F.least(F.col("idx") + 1, F.lit(n)).cast("double")
        return over

    return Feature([run, {k: mean(n) for k, n in sizes.items()}], max(sizes.values()), helpers=["_run"])


def wide_max(sizes: dict[str, int], value: str, *, keys: Sequence[str] = ()) -> Feature:
    """Rolling maximum in O(1) per row for windows of any size. Panes as long as the window are
    scanned forwards and backwards; a window is the end of one pane and the start of the next."""
    return _paned(sizes, keys, {"m": F.max(value)},
                  lambda new, old, joined: F.greatest(new["m"], F.when(joined, old["m"])))


def wide_std(sizes: dict[str, int], value: str, *, keys: Sequence[str] = ()) -> Feature:
    """Rolling sample deviation in O(1) per row, merging the moments of two panes (no cancellation);
    0 while there is only one value."""
    def merge(new, old, joined):
        na, nb = (F.coalesce(F.when(c, s["n"]), F.lit(0)).cast("double") for c, s in ((F.lit(True), new), (joined, old)))
        n = na + nb
        d = F.coalesce(F.when(joined, old["avg"]), F.lit(0.0)) - F.coalesce(new["avg"], F.lit(0.0))
        m2 = na * F.coalesce(new["var"], F.lit(0.0)) + nb * F.coalesce(F.when(joined, old["var"]), F.lit(0.0)) \
            + F.coalesce(F.try_divide(d * d * na * nb, n), F.lit(0.0))
        return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(m2, n - 1)))

    return _paned(sizes, keys, {"n": F.count(value), "avg": F.avg(value), "var": F.var_pop(value)}, merge)


def _paned(sizes, keys, aggregates, merge) -> Feature:
    names = {out: f"_{out}" for out in sizes}
    panes, scans, ends, final = {}, {}, {}, {}
    for out, n in sizes.items():
        h = names[out]
        panes[h + "_p"] = lambda w, n=n: F.floor(F.col("idx") / n)
        for suffix, order in (("_f", F.col("idx").asc()), ("_b", F.col("idx").desc())):
            over = W.partitionBy(*keys, "_block", h + "_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
            scans[h + suffix] = lambda w, over=over: F.struct(
                *[a.over(over).alias(k) for k, a in aggregates.items()])
        ends[h + "_o"] = lambda w, h=h, n=n: F.lag(h + "_b", n - 1).over(w)
        joined = F.col(h + "_o").isNotNull() & (F.col("idx") % n != n - 1)
        final[out] = lambda w, h=h, j=joined: merge(F.col(h + "_f"), F.col(h + "_o"), j)
    helpers = [h + s for h in names.values() for s in ("_p", "_f", "_b", "_o")]
    return Feature([panes, scans, ends, final], max(sizes.values()), helpers=helpers)


def rolling_median_spread(value: str, window: int = 60) -> Feature:
    """``_med`` and ``_std`` of the trailing window (deviation 1 for a single row)."""
    return Feature([{
        "_med": lambda w: F.expr(f"percentile({value}, 0.5)").over(w.rowsBetween(-(window - 1), 0)),
        "_std": lambda w: F.coalesce(F.stddev_samp(value).over(w.rowsBetween(-(window - 1), 0)), F.lit(1.0)),
    }], window)


def apply(df: DataFrame, *features: Feature, keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Run features side by side over shared blocks."""
    depth = max(len(f.stages) for f in features)
    stages = [
        {k: v for f in features if level < len(f.stages) for k, v in f.stages[level].items()}
        for level in range(depth)]
    out = over_blocks(df, *stages, keys=keys, trailing=max(f.trailing for f in features),
                      leading=max(f.leading for f in features), rows=rows)
    return out.drop(*[h for f in features for h in f.helpers])


def outlier_flags(df: DataFrame, value: str, *, window: int = 60, sigma: float = 3.0,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Marks values further than ``sigma`` deviations from the trailing median."""
    spread = apply(df, rolling_median_spread(value, window), keys=keys)
    z = F.abs((F.col(value) - F.col("_med")) / F.greatest(F.col("_std"), F.lit(1e-6)))
    return spread.withColumn("is_outlier", z > sigma).drop("_med", "_std")


def outlier_ratio(df: DataFrame, value: str, *, window: int = 60, sigma: float = 3.0,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Share of outliers, six decimals; 0 for series shorter than the window."""
    flags = outlier_flags(df, value, window=window, sigma=sigma, keys=keys)
    n, hits = F.count(F.lit(1)), F.count_if("is_outlier")
    return flags.groupBy(*keys).agg(
        F.when(n < window, F.lit(0.0)).otherwise(F.round(F.try_divide(hits, n), 6)).alias("outlier_ratio"))
