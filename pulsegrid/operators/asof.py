"""As-of join: to every row the newest measurement at or before its time.

Both sides are cut into time slices. Inside a slice a window over the measurements and rows together finds the newest; what
lies before the slice comes from a carry table with one row per key and slice. So a hot key spreads over as many
tasks as it has slices, and no side is sorted as a whole or matched by a range condition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import null_safe_join, slice_of

HOUR = 3600


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, ts: str = "ts", right_ts: str = "ts", values: Sequence[str],
              tie: Sequence[str] = (), tolerance: int | None = None, seconds: int = HOUR, matched: str | None = None) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the newest row of ``right`` of its keys at or before ``ts``.

    ``tolerance`` is the age in seconds beyond which a measurement no longer counts (one exactly that old does). Of measurements with one
    time the last by ``tie`` is taken. ``matched`` names a column for the time of the measurement. NULL keys match NULL
    keys; rows without time, and rows without measurement, are kept with NULL values; measurements without time are none.
    """
    keys = list(keys)
    named = F.struct(F.col(right_ts).alias("_at"), *[F.col(c).alias(f"_t{k}") for k, c in enumerate(tie)], *[F.col(c).alias(f"_v{k}") for k, c in enumerate(values)])
    given = right.where(F.col(right_ts).isNotNull()).select(*keys, slice_of(F.col(right_ts), seconds).alias("_slice"), named.alias("_m"))
    rows = left.withColumn("_slice", slice_of(F.col(ts), seconds))
    dated, undated = rows.where(F.col("_slice").isNotNull()), rows.where(F.col("_slice").isNull())

    last = given.groupBy(*keys, "_slice").agg(F.max("_m").alias("_last"))
    asked = dated.select(*keys, "_slice").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    slices = last.unionByName(asked).groupBy(*keys, "_slice").agg(F.max("_last").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_in"))

    whole = F.struct(*[F.col(c) for c in left.columns])
    nothing = F.lit(None)
    both = dated.select(*keys, "_slice", F.col(ts).alias("_ts"), F.lit(1).alias("_side"), whole.alias("_row"),
                        nothing.cast(last.schema["_last"].dataType).alias("_m")).unionByName(
        given.select(*keys, "_slice", F.col("_m._at").alias("_ts"), F.lit(0).alias("_side"), nothing.cast(left.schema).alias("_row"), "_m"))
    order = W.partitionBy(*keys, "_slice").orderBy("_ts", "_side", *[F.col(f"_m._t{k}") for k in range(len(tie))])
    seen = both.withColumn("_m", F.last("_m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).where("_side = 1")
    found = null_safe_join(seen, carry, [*keys, "_slice"], exact=["_slice"]).withColumn("_m", F.coalesce("_m", "_in"))
    if tolerance is not None:
        young = F.col("_ts") <= F.col("_m._at") + F.make_dt_interval(secs=F.lit(tolerance))
        found = found.withColumn("_m", F.when(young, F.col("_m")))
    out = [*([F.col("_m._at").alias(matched)] if matched else []), *[F.col(f"_m._v{k}").alias(c) for k, c in enumerate(values)]]
    joined = found.select("_row.*", *out)
    empty = [F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in [*([matched] if matched else []), *values]]
    return joined.unionByName(undated.select(*left.columns, *empty))
