"""The feature vector per request event as a continuous job.

Every micro-batch runs the batch plan of :mod:`pulsegrid.plans.event_features` on the new events plus
two small carried tables: the seconds of the last half hour and the last rates per endpoint. A keyed
state operator would pin a busy endpoint to one task; here it spreads over time slices and blocks as
in the batch job, stays in the JVM, and gives the same numbers.

Order: within a micro-batch by (millisecond, event_id); across micro-batches by arrival. A late event
sees the seconds up to its own and continues averages and history where they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.ordered import null_safe_join
from pulsegrid.plans import event_features as ef
from pulsegrid.schema import FEATURE_COLS
from pulsegrid.session import drop_folder, scratch
from pulsegrid.streaming.state import StateTable, write_batch

COUNT_RETENTION = 1800  # fixed value: seconds of counts kept
LATENCY_RETENTION = 900  # fixed value: seconds of latencies kept
IDLE_TTL = 86_400  # seconds after which a silent endpoint is forgotten
LATE_AFTER = 1800  # seconds behind the newest event at which one goes to the side table


def retain_seconds(seconds: DataFrame, *, idle_ttl: int | None = None) -> DataFrame:
    """Keep each endpoint's last half hour (a quarter of an hour of latencies); with ``idle_ttl``
    also forget endpoints silent for that many seconds."""
    newest = seconds.groupBy("endpoint").agg(F.max("sec").alias("_top"))
    if idle_ttl is not None:
        overall = newest.agg(F.max("_top").alias("_all"))
        newest = newest.crossJoin(F.broadcast(overall)).filter(F.col("_top") >= F.col("_all") - idle_ttl).drop("_all")
    kept = null_safe_join(seconds, newest, ["endpoint"]).filter(F.col("sec") >= F.col("_top") - COUNT_RETENTION)
    recent = F.when(F.col("sec") >= F.col("_top") - LATENCY_RETENTION, F.col("last_latency"))
    return kept.select("endpoint", "sec", "cnt", recent.alias("last_latency"))


def feature_batch(output: str, state: str, *, late: str | None = None, late_after: int = LATE_AFTER,
                  idle_ttl: int | None = IDLE_TTL, rows: int | None = None,
                  sink: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: vectors go to ``output``, state to ``state``, events older than
    the watermark to ``late`` (without it they are processed like the others)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seconds_table, rates_table = StateTable(spark, state, "seconds"), StateTable(spark, state, "rates")
        events = batch.select("event_id", "ts", "endpoint", "latency_ms").persist()
        carried, history = seconds_table.before(batch_id), rates_table.before(batch_id)
        usable = events
        if late is not None and carried is not None:
            newest = carried.agg(F.max("sec").alias("_top"))
            marked = events.crossJoin(F.broadcast(newest)).withColumn(
                "_late", F.coalesce(F.unix_seconds("ts") < F.col("_top") - late_after, F.lit(False)))
            write_batch(marked.filter("_late").drop("_top", "_late"), late, batch_id)
            usable = marked.filter(~F.col("_late")).drop("_top", "_late")

        aside = scratch(spark, "seconds")
        ef.per_second(usable).write.parquet(aside)
        fresh = spark.read.parquet(aside)
        vectors = ef.feature_vectors(usable, carried=carried, history=history, seconds=fresh,
                                     extra=["seq", "total_60s"], rows=rows)
        write_batch(vectors, output, batch_id)
        if sink is not None:
            sink(spark.read.parquet(f"{output}/batch_id={batch_id}").drop("seq", "total_60s"), batch_id)

        seconds = ef.combine_seconds(fresh, carried)
        seconds_table.after(batch_id, retain_seconds(seconds, idle_ttl=idle_ttl))
        drop_folder(spark, aside)
        alive = seconds_table.before(batch_id + 1).select("endpoint").distinct()
        known = spark.read.parquet(f"{output}/batch_id={batch_id}").select("endpoint", "seq", "req_rate_1m", "total_60s")
        if history is not None:
            known = known.unionByName(history)
        known = null_safe_join(known, alive, ["endpoint"])
        ends = known.groupBy("endpoint").agg((F.max("seq") - ef.KEPT_RATES).alias("_floor"))
        rates_table.after(batch_id, null_safe_join(known, ends, ["endpoint"]).filter(F.col("seq") > F.col("_floor")).drop("_floor"))
        events.unpersist()

    return run


def start_feature_stream(events: DataFrame, output: str, state: str, checkpoint: str, *,
                         available_now: bool = False, interval: str = "5 seconds", **options) -> StreamingQuery:
    """``events`` is a streaming frame of decoded request events."""
    writer = events.writeStream.foreachBatch(feature_batch(output, state, **options)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_vectors(spark, output: str) -> DataFrame:
    return spark.read.parquet(output).select("event_id", "endpoint", "timestamp", *FEATURE_COLS)
