"""Exact percentiles without holding all values in one aggregation buffer.

Spark's exact ``percentile`` keeps every distinct value of a group in memory. Here a mergeable
sketch brackets the wanted rank first; only values inside the bracket are counted (grouped by value,
so ties collapse) and scanned for the exact order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import null_safe_join

ACCURACY = 10_000
MARGIN = 2.5 / ACCURACY
SMALL = 4 * ACCURACY  # below this many values the bracket is the whole range


def exact_percentiles(df: DataFrame, value: str, percentiles: dict[str, float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the linearly interpolated percentiles of the non-NULL values."""
    keys = list(keys)
    names = list(percentiles)
    probes = F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in percentiles.values() for d in (-MARGIN, MARGIN)])
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    brackets = values.groupBy(*keys).agg(
        F.percentile_approx("_x", probes, ACCURACY).alias("_q"), F.count(F.lit(1)).alias("_n"))
    spans = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi"))
        for i in range(len(names))])
    brackets = brackets.select(*keys, "_n", F.explode(spans).alias("_s")).select(
        *keys, "_n", F.col("_s.i").alias("_i"),
        F.when(F.col("_n") <= SMALL, F.lit(float("-inf"))).otherwise(F.col("_s.lo")).alias("_lo"),
        F.when(F.col("_n") <= SMALL, F.lit(float("inf"))).otherwise(F.col("_s.hi")).alias("_hi"))

    joined = null_safe_join(values, brackets, keys) if keys else values.crossJoin(F.broadcast(brackets))
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    # values below the bracket fall together into one row, those inside stay apart by value
    counted = (
        joined.filter(F.col("_x") <= F.col("_hi"))
        .groupBy(*keys, "_i", "_n", F.when(inside, F.col("_x")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = W.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(w))
    p = F.element_at(F.array(*[F.lit(float(v)) for v in percentiles.values()]), F.col("_i") + 1)
    pos = (F.col("_n") - 1) * p
    picked = ranked.withColumn("_pos", pos).groupBy(*keys, "_i", "_pos").agg(
        F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > F.floor("_pos")), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > F.ceil("_pos")), F.col("_v"))).alias("_b"))
    frac = F.col("_pos") - F.floor("_pos")
    result = picked.withColumn("_r", F.col("_a") + (F.coalesce("_b", "_a") - F.col("_a")) * frac)
    return result.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(n) for i, n in enumerate(names)])


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "median") -> DataFrame:
    return exact_percentiles(df, value, {out: 0.5}, keys)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))
