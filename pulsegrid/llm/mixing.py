"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks in the order of a hash. Block ``i`` (from 1) of a source with
weight ``w`` is released at slot ``floor((i-1)/w)`` and due by slot ``ceil(i/w)``; each slot takes the released
block that is due first. While every source lasts, the number of blocks a source has had by any slot ``t``
differs from ``w*t`` by less than one block. Weights are the exact fractions that the given numbers stand for.
The order depends on the weights and the sources' numbers of blocks alone: the driver works it out, one heap
step a block, and writes it as a table with the slots of ``SLOTS`` consecutive blocks of a source in a row, which
documents are joined with. When a source runs out, a new phase begins in which the others share its slots by
their weights; so no document is left out.

* null source: a source of its own, named by ``null_source``; null, empty or long texts are not looked at;
* a source without a weight, or with weight 0, comes after all others, in weight order of equals;
* repeated document ids: each row has its own place, next to each other;
* an empty table gives no rows; extra columns are carried unless they are called like an output.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import count
from math import isqrt, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.store import stored
from pulsegrid.session import scratch

BLOCK = 16
SLOTS = 1000  # of a source in a row of the schedule
WRITTEN = 1 << 20  # slots that are written at a time
SMALL = 1 << 20  # slots up to which the schedule is broadcast
OUTPUT = ["block", "phase", "slot", "position"]


def shares(weights: Mapping[str, float], slots: int = 1) -> dict[str, Fraction]:
    """What each source should get of ``slots`` slots: exactly, not rounded."""
    given = {n: Fraction(w) for n, w in sorted(weights.items()) if w > 0}
    total = sum(given.values())
    return {n: w / total * slots for n, w in given.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[int, int, str, int]]:
    """Phase, slot, source and block, slot by slot: earliest deadline first among the released blocks; ties by name.

    One phase ends per source.
    """
    left = {n: b for n, b in blocks.items() if b > 0}
    taken, slot, phase = dict.fromkeys(left, 0), 0, 0
    while left:
        share = shares({n: weights.get(n, 0) for n in left if weights.get(n, 0) > 0} or dict.fromkeys(left, 1))
        whole = lcm(*(w.denominator for w in share.values()))  # weights are multiples of 1/whole
        part = {n: int(w * whole) for n, w in share.items()}
        done = dict.fromkeys(share, 0)
        waiting, ready = [(0, n) for n in share], []
        for t in count():
            while waiting and waiting[0][0] <= t:
                _, n = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(done[n] + 1) * whole // part[n]), n))
            _, n = heapq.heappop(ready)
            yield phase, slot, n, taken[n]
            slot, done[n], taken[n], left[n] = slot + 1, done[n] + 1, taken[n] + 1, left[n] - 1
            if not left[n]:
                break
            heapq.heappush(waiting, (done[n] * whole // part[n], n))
        left = {n: b for n, b in left.items() if b > 0}
        phase += 1


def tempered(counts: Mapping[str, int]) -> dict[str, float]:
    """Target weights in proportion to the square root of a source's size."""
    return {n: float(isqrt(c * 1_000_000)) for n, c in counts.items()}


def ranks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """0-based rank of each row in its source: ranged by Spark, so no source is one task's."""
    ranged = stored(docs.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy("_source", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from"))
    return (ranged.withColumn("_part", part)  # a row for each source in each partition
            .join(F.broadcast(offsets.drop("_n", "_from")), ["_source", "_part"])
            .withColumn("_rank", F.col("_off") + F.col("_at")).drop("_part", "_off", "_at"))


def _scheduled(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float],
               chunk: int) -> tuple[DataFrame, list[int], dict[str, int]]:
    """The slots of each source, ``chunk`` blocks to a row; the first slot of each phase; the last slot of each source."""
    path, schema = scratch(spark, "slots"), "_source string, _chunk long, _slots array<long>"
    starts: list[int] = []
    last: dict[str, int] = {}
    opened: dict[str, array] = {}
    full: list[tuple[str, int, array]] = []

    def write() -> None:
        names, chunks, slots = zip(*full, strict=True) if full else ((), (), ())
        bounds = np.cumsum([0, *map(len, slots)])
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in slots)]))
        table = pa.table({"_source": pa.array(names, pa.string()), "_chunk": pa.array(chunks, pa.int64()),
                          "_slots": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)})
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)
        full.clear()

    for phase, slot, n, b in schedule(blocks, weights):
        if phase == len(starts):
            starts.append(slot)
        last[n] = slot
        own = opened.setdefault(n, array("q"))
        own.append(slot)
        if len(own) == chunk:
            full.append((n, b // chunk, opened.pop(n)))
            if len(full) * chunk >= WRITTEN:
                write()
    full += [(n, (blocks[n] - 1) // chunk, own) for n, own in opened.items()]
    write()
    return spark.read.schema(schema).parquet(path), starts, last


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, id_col: str = "doc_id",
        source_col: str = "source", block: int = BLOCK, slots: int = SLOTS, null_source: str = "") -> DataFrame:
    """The documents with ``block`` (of the source), ``phase``, ``slot`` (of the block) and ``position``.

    ``position`` counts documents from 0 without gaps. ``weights`` defaults to :func:`tempered` sizes. On the
    driver: one number per source, at most ``slots`` slots of each source's blocks, and those not yet written out.
    """
    own = [c for c in docs.columns if c not in OUTPUT]
    hidden = docs.select(*own, F.coalesce(F.col(source_col).cast("string"), F.lit(null_source)).alias("_source"),
                         F.xxhash64(F.col(id_col), F.lit(17)).alias("_hash"))
    ranked = ranks(hidden, ["_source", "_hash", id_col])
    counts = {r["_source"]: r["n"] for r in ranked.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    blocks = {n: -(-c // block) for n, c in counts.items()}
    table, starts, last = _scheduled(spark, blocks, weights or tempered(counts), slots)
    if sum(blocks.values()) <= SMALL:
        table = F.broadcast(table)
    # the last block of a source may be short: what follows moves up
    short = [{"slot": last[n], "by": blocks[n] * block - c} for n, c in counts.items()]
    gaps = F.from_json(F.lit(json.dumps(short)), "array<struct<slot:long,by:long>>")
    begins = F.from_json(F.lit(json.dumps(starts)), "array<long>")
    return (
        ranked.withColumn("block", F.floor(F.col("_rank") / block)).withColumn("_chunk", F.floor(F.col("block") / slots))
        .join(table, ["_source", "_chunk"])  # a row per source and ``slots`` of its blocks
        .withColumn("slot", F.get("_slots", (F.col("block") % slots).cast("int")))
        .withColumn("phase", F.size(F.filter(begins, lambda b: b <= F.col("slot"))) - 1)
        .withColumn("position", F.col("slot") * block + F.col("_rank") % block - F.aggregate(
            F.filter(gaps, lambda g: g["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda s, g: s + g["by"]))
        .select(*own, "block", "phase", "slot", "position")
    )
