"""Ordered-series building blocks that never put a whole series into one task.

A window without a partition key, or keyed by a hot endpoint, runs in a single task. The helpers
here cut a series into blocks of bounded size, copy the few neighbouring rows ("halo") that a frame
needs into each block, and carry running state between blocks through a table with one row per
block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.session import materialise

DAY = 86_400
MIN_BLOCK = 16_384
SUB = 128  # rows per sub-block of the exponential averages


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", exact: Sequence[str] = ()) -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys come from the left. ``exact`` are those keys that are never NULL."""
    named = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(named)
    on = [left[k] == other[r] if k in exact else left[k].eqNullSafe(other[r]) for k, r in named.items()]
    return left.join(other, on, how).drop(*named.values())


def slice_of(ts: Column, seconds: int = DAY) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key. For small per-slice tables only."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def time_index(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = (), *,
               seconds: int = DAY, out: str = "idx") -> DataFrame:
    """0-based position of each row in its series. Needs one row per (keys, timestamp), so a slice
    holds at most ``seconds`` divided by the series resolution rows.

    Per-slice counts (pre-aggregated, one row per slice) give the offset, a window inside the slice
    gives the rest.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_of(F.col(ts), seconds))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_before(counts, keys, ["_slice"], "_n", "_off").drop("_n")
    w = W.partitionBy(*keys, "_slice").orderBy(ts)
    return (
        sliced.withColumn("_rn", F.row_number().over(w))
        .transform(lambda d: null_safe_join(d, offsets, [*keys, "_slice"]))
        .withColumn(out, F.col("_off") + F.col("_rn") - 1)
        .drop("_slice", "_rn", "_off")
    )


def row_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """0-based position of each row in a total order, for tables with many rows per timestamp.

    ``order`` must be unique (end it with an id). Spark's range partitioner balances the rows
    whatever their distribution; the ranged rows are checkpointed because the per-partition counts
    and the positions have to come from the same partitioning.
    """
    position = F.monotonically_increasing_id()
    ranged = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(position, 33))
        .withColumn("_pos", position.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_before(counts, [], ["_part"], "_n", "_off").drop("_n")
    return (
        ranged.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(out, F.col("_off") + F.col("_pos"))
        .drop("_part", "_pos", "_off")
    )


def with_halo(df: DataFrame, idx: str, rows: int, trailing: int = 0, leading: int = 0) -> DataFrame:
    """Assign rows to blocks of ``rows`` positions and copy block edges into the neighbours.

    Adds ``_own`` and ``_block``; a row is a halo copy where the two differ.
    """
    if rows <= trailing + leading:
        raise ValueError("a block must be longer than its halo")
    i = F.col(idx)

    def block(c: Column) -> Column:
        return F.floor(c / F.lit(rows))

    blocks = F.array_distinct(F.array(
        block(i), block(i + trailing), block(F.greatest(i - leading, F.lit(0)))))
    return df.withColumn("_own", block(i)).withColumn("_block", F.explode(blocks))


def over_blocks(df: DataFrame, *stages: Mapping[str, Callable[[W], Column]], keys: Sequence[str] = (),
                idx: str = "idx", trailing: int = 0, leading: int = 0, rows: int | None = None) -> DataFrame:
    """Row-frame window expressions over an indexed series, computed block by block.

    Each stage maps output names to ``window -> Column``; a stage may use the outputs of earlier
    ones (same partitioning and order, so no further shuffle or sort). Frames of all stages together
    may reach ``trailing`` rows back and ``leading`` rows ahead.
    """
    rows = rows or max(MIN_BLOCK, 16 * (trailing + leading))
    rows += -rows % SUB  # whole sub-blocks
    halo = with_halo(df, idx, rows, trailing, leading).withColumn("_sub", F.floor(F.col(idx) / SUB))
    # ordering by (_sub, idx) is ordering by idx; it lets windows over a sub-block share the sort
    w = W.partitionBy(*keys, "_block").orderBy("_sub", idx)
    for stage in stages:
        halo = halo.select("*", *[fn(w).alias(name) for name, fn in stage.items()])
    return halo.filter(F.col("_own") == F.col("_block")).drop("_own", "_block", "_sub")


def ewma_stages(value: Column, alphas: Mapping[str, float], *, keys: Sequence[str] = (),
                idx: str = "idx", adjust: bool = False) -> tuple[list[dict], int, list[str]]:
    """Stages for :func:`over_blocks` that compute exponential averages in O(1) per row.

    Inside a sub-block of ``SUB`` rows the average is a running sum of values scaled by the inverse
    decay; the previous sub-block enters through its last value. What lies further back weighs less
    than (1-alpha)**SUB, below double precision for alpha >= 0.3. Returns the stages, the rows of
    halo they need and the helper columns to drop. ``adjust`` divides by the sum of the weights
    instead of seeding with the first value.
    """
    if min(alphas.values()) < 0.25:
        raise ValueError("alpha below 0.25 reaches further back than one sub-block")
    position = F.col(idx) % SUB
    local = W.partitionBy(*keys, "_block", "_sub").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)

    def earlier(w):
        return w.rowsBetween(W.unboundedPreceding, -1)

    sums, carries, final, helpers = {}, {}, {}, []
    for name, alpha in alphas.items():
        q = F.lit(1.0 - alpha)
        seed = F.lit(1.0) if not adjust else F.lit(alpha)
        weight = F.when(F.col(idx) == 0, seed).otherwise(F.lit(alpha)) * F.pow(q, -position)
        s, p = f"_s_{name}", f"_p_{name}"
        sums[s] = lambda w, x=weight * value, q=q: F.pow(q, position) * F.sum(x).over(local)
        carries[p] = lambda w, s=s: F.last(
            F.when(position == SUB - 1, F.col(s)), ignorenulls=True).over(earlier(w))
        average = F.col(s) + F.pow(q, position + 1) * F.coalesce(F.col(p), F.lit(0.0))
        if adjust:  # total weight of i+1 rows: 1 - (1-alpha)^(i+1)
            average = average / (F.lit(1.0) - F.pow(q, F.col(idx) + 1))
        final[name] = lambda w, c=average: c
        helpers += [s, p]
    return [sums, carries, final], SUB, helpers


def fill_from_neighbours(df: DataFrame, value: str, *, ts: str = "timestamp", keys: Sequence[str] = (),
                         seconds: int = DAY) -> DataFrame:
    """Nearest known value and its timestamp before (``_pv``, ``_pt``) and after (``_nv``, ``_nt``)
    each row, itself included. Inside a time slice by window; across slices by a carry table with
    one row per slice.
    """
    keys = list(keys)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    sliced = df.withColumn("_slice", slice_of(F.col(ts), seconds)).withColumn("_k", known)
    edges = sliced.groupBy(*keys, "_slice").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"))
    back = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # backwards scans: a frame that grows is O(1) per row, one open to the end would be rescanned
    ahead = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select(
        *keys, "_slice",
        F.last("_last", ignorenulls=True).over(back).alias("_in"),
        F.last("_first", ignorenulls=True).over(ahead).alias("_out"),
    )
    own = W.partitionBy(*keys, "_slice")
    growing = (W.unboundedPreceding, 0)
    return (
        sliced
        .withColumn("_p", F.last("_k", ignorenulls=True).over(own.orderBy(ts).rowsBetween(*growing)))
        .withColumn("_n", F.last("_k", ignorenulls=True).over(own.orderBy(F.desc(ts)).rowsBetween(*growing)))
        .transform(lambda d: null_safe_join(d, carry, [*keys, "_slice"]))
        .withColumn("_p", F.coalesce("_p", "_in"))
        .withColumn("_n", F.coalesce("_n", "_out"))
        .select(*df.columns, F.col("_p.v").alias("_pv"), F.col("_p.t").alias("_pt"),
                F.col("_n.v").alias("_nv"), F.col("_n.t").alias("_nt"))
    )
