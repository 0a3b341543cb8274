"""Request metrics of a stream: counts, error share and latency histogram per endpoint, by minute and over sliding windows.

Sliding windows are a second stateful step behind the first: an event is counted in its minute once, and only the
minutes, one row per label set, are copied into the windows that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.web import status_matches
from pulsegrid.operators.metrics import LATENCY_BOUNDS, LE_NAMES, histogram_quantile


COUNTS = ("requests", "errors", *LE_NAMES, "le_inf")


def _counted(events: DataFrame, watermark: str, interval: str, by: tuple[str, ...]) -> DataFrame:
    """Tumbling windows with partial aggregation; state is dropped behind the watermark."""
    seconds = F.col("latency_ms") / 1000.0
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", interval), *by)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(status_matches(F.col("status"), "5..")).alias("errors"),
            *[F.count_if(seconds <= b).alias(n) for b, n in zip(LATENCY_BOUNDS, LE_NAMES)],
            F.count("latency_ms").alias("le_inf")))


def minute_metrics(events: DataFrame, *, watermark: str = "30 minutes", interval: str = "1 minute",
                   by: tuple[str, ...] = ("endpoint",)) -> DataFrame:
    """Counts of each minute and label set."""
    return _counted(events, watermark, interval, by).select(F.col("window.start").alias("window_start"), *by, *COUNTS)


def sliding_metrics(events: DataFrame, *, watermark: str = "10 minutes", interval: str = "1 minute", window: str = "5 minutes",
                    by: tuple[str, ...] = ("endpoint",)) -> DataFrame:
    """The same counts over windows of ``window`` that begin every ``interval``, ``requests`` being the increase. To be
    written in append mode: a window comes out, once, when the watermark has passed its end."""
    minutes = _counted(events, watermark, interval, by)
    return minutes.groupBy(F.window(F.window_time("window"), window, interval).alias("_w"), *by).agg(
        *[F.sum(c).alias(c) for c in COUNTS]).select(F.col("_w.start").alias("window_start"), *by, *COUNTS)


def limited_hits_stream(decisions: DataFrame, *, watermark: str = "10 minutes", interval: str = "1 minute", window: str = "5 minutes",
                        slide: str = "1 minute") -> DataFrame:
    """Rejected requests per client over sliding windows, from the decisions of the limiter's stream (``event_id, client_id, ts,
    allowed``). A decision that was written twice, as by a replayed micro-batch, counts once (by ``event_id``, never NULL). For append mode."""
    rejected = decisions.where(~F.col("allowed")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    minutes = rejected.groupBy(F.window("ts", interval), "client_id").agg(F.count(F.lit(1)).alias("hits"))
    return minutes.groupBy(F.window(F.window_time("window"), window, slide).alias("_w"), "client_id").agg(
        F.sum("hits").alias("hits")).select(F.col("_w.start").alias("window_start"), "client_id", "hits")


def start_append_stream(frame: DataFrame, path: str, checkpoint: str, *, available_now: bool = False,
                        interval: str = "1 minute") -> StreamingQuery:
    """Finished windows to a folder."""
    writer = frame.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start(path)


def with_rates(metrics: DataFrame, seconds: float = 60.0, q: float = 0.95) -> DataFrame:
    """Rates, error ratio and latency quantile from the stored counts."""
    rated = metrics.withColumns({
        "rate": F.col("requests") / F.lit(seconds), "error_rate": F.col("errors") / F.lit(seconds),
        "error_ratio": F.try_divide("errors", "requests")})
    return histogram_quantile(rated, q).withColumn("latency_ms", F.col("quantile") * 1000.0).drop(
        "quantile", *LE_NAMES, "le_inf")
