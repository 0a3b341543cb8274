"""The request limiter over a stream: every micro-batch is decided by the batch plan.

What is carried from one micro-batch to the next is a table of the windows that clients have open. So the
result depends neither on the order of rows nor on the size of Arrow batches, no client is pinned to one task,
and clients that are idle for longer than a window drop out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.limiter import LIMIT, WINDOW_MS, rate_limit
from pulsegrid.session import drop_folder, scratch
from pulsegrid.streaming.state import StateTable, write_batch

LATE_MS = 600_000  # how far behind the newest request a window is still remembered


def limit_batch(output: str, state: str, *, limit: int = LIMIT, window_ms: int = WINDOW_MS, path: str = "path",
                late_ms: int = LATE_MS) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: every request with its decision to ``output``, open windows to ``state``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = StateTable(spark, state, "windows")
        before = table.before(batch_id)
        # read several times by the plan, and a stream's batch need not come in the same order again
        given = scratch(spark, "requests")
        batch.write.parquet(given)
        rows = spark.read.schema(batch.schema).parquet(given)
        decided = rate_limit(rows, limit=limit, window_ms=window_ms, path=path, carried=before, anchors=True)
        decided = decided.withColumn("at", F.greatest(F.unix_millis("ts"), "anchor"))
        write_batch(decided, output, batch_id)
        done = spark.read.schema(decided.schema).parquet(f"{output}/batch_id={batch_id}").where("anchor IS NOT NULL")
        fresh = done.groupBy(F.col("limited_client").alias("client"), "anchor").agg(
            F.max("window_count").alias("used"), F.max("at").alias("seen"))
        windows = fresh if before is None else before.unionByName(fresh)
        ends = windows.groupBy("client").agg(F.max("anchor").alias("anchor"))
        newest = windows.agg(F.max("seen").alias("_now"))  # a single row
        kept = (windows.join(ends, ["client", "anchor"]).groupBy("client", "anchor").agg(F.max("used").alias("used"), F.max("seen").alias("seen"))
                .crossJoin(F.broadcast(newest)).where(F.col("anchor") + window_ms + late_ms >= F.col("_now")).drop("_now"))
        table.after(batch_id, kept)
        drop_folder(spark, given)

    return run


def start_limit_stream(requests: DataFrame, output: str, state: str, checkpoint: str, *, available_now: bool = False,
                       interval: str = "5 seconds", **options) -> StreamingQuery:
    """``requests`` is a streaming frame of ``event_id, client_id, ts`` and a path."""
    writer = requests.writeStream.foreachBatch(limit_batch(output, state, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def read_decisions(spark, output: str) -> DataFrame:
    return spark.read.parquet(output).drop("limited_client", "anchor", "at", "batch_id")
