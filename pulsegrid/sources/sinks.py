"""Sinks: feature and decision tables, message forms, reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.schema import AUDIT_COLS, FEATURE_COLS, FEATURE_VECTOR, LABEL_COLS
from pulsegrid.session import drop_folder, scratch


def feature_messages(vectors: DataFrame) -> DataFrame:
    """Feature vectors as ``(key, value, timestamp)`` messages keyed by endpoint."""
    return vectors.select(
        F.col("endpoint").alias("key"),
        F.to_json(F.struct("endpoint", "timestamp", *FEATURE_COLS)).alias("value"), "timestamp")


def parse_feature_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors, and the messages that are none."""
    parsed = messages.withColumn("_v", F.from_json("value", FEATURE_VECTOR))
    broken = F.col("_v").isNull() | F.col("_v.endpoint").isNull()
    return parsed.filter(~broken).select("_v.*"), parsed.filter(broken).drop("_v")


def latest_per_key(points: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Upsert semantics: the last arrival of each key wins. Combines before the shuffle, so many
    rewrites of one key cost nothing."""
    rest = [c for c in points.columns if c not in keys]
    newest = points.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_p"))
    return newest.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def upsert_points(batch: DataFrame, path: str, keys: Sequence[str] = ("endpoint", "timestamp"),
                  arrival: str = "arrival") -> None:
    """Merge a batch into a date-partitioned table, rewriting only the days it touches."""
    spark = batch.sparkSession
    fresh = batch.withColumn("day", F.to_date("timestamp"))
    days = [r["day"] for r in fresh.select("day").distinct().collect()]  # the calendar days a batch touches
    merged = fresh
    try:
        merged = touched_days(spark.read.schema(fresh.schema).parquet(path), days).unionByName(fresh)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    # reads and rewrites the same folder, so the result is written down first
    aside = scratch(spark, "upsert")
    latest_per_key(merged, [*keys, "day"], arrival).write.parquet(aside)
    spark.read.schema(merged.schema).parquet(aside).select(*merged.columns).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    drop_folder(spark, aside)


def touched_days(points: DataFrame, days: Sequence) -> DataFrame:
    """The partitions of the given days; known before the scan is planned, so no other is read."""
    known = F.col("day").isin([d for d in days if d is not None])
    return points.filter(known | F.col("day").isNull() if None in days else known)


def since_newest(points: DataFrame, days: int) -> DataFrame:
    """Of a table partitioned by day, the newest day and ``days`` before it; other tables as they are.

    The newest day is looked up in the partition column alone, and the filter prunes partitions.
    """
    if "day" not in points.columns:
        return points
    top = points.agg(F.max("day").cast("date").alias("top")).first()["top"]
    return points if top is None else points.filter(F.col("day") >= F.lit(top - timedelta(days=days)))


def retain_days(points: DataFrame, days: int, ts: str = "timestamp") -> DataFrame:
    """Points of the last ``days`` days before the newest one."""
    points = since_newest(points, days + 1)
    newest = points.agg(F.max(ts).alias("_newest"))
    return points.crossJoin(F.broadcast(newest)).filter(
        F.col(ts) >= F.col("_newest") - F.make_dt_interval(days=F.lit(days))).drop("_newest")


def training_columns(features: DataFrame, *, keep_timestamp: bool = True) -> DataFrame:
    """The training table: every feature and label, absent ones as 0, single precision."""
    present = set(features.columns)
    cols = [
        (F.col(c) if c in present else F.lit(0.0)).cast("float").alias(c) for c in FEATURE_COLS + LABEL_COLS]
    return features.select(*(["timestamp"] if keep_timestamp and "timestamp" in present else []), *cols)


def write_training_table(features: DataFrame, path: str) -> None:
    training_columns(features).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One-row quality report as JSON."""
    report.write.mode("overwrite").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.select(*AUDIT_COLS).withColumn("day", F.to_date("timestamp")) \
        .write.mode("append").partitionBy("day").parquet(path)


def notifications(records: DataFrame) -> DataFrame:
    """Message per dispatched decision."""
    payload = F.struct(
        F.col("scale_action").alias("action"), "predicted_rate", "confidence", "desired_replicas",
        "actual_replicas", "provisioning_latency_ms", F.unix_millis("timestamp").alias("timestamp"))
    return records.filter(F.col("action_type") == "DISPATCH").select(
        F.col("service").alias("key"), F.to_json(payload).alias("value"))


def start_message_stream(messages: DataFrame, checkpoint: str, *, fmt: str = "kafka", path: str | None = None,
                         available_now: bool = False, **options: str):
    """Writes ``key, value`` messages of a stream (events, vectors, notifications) to a topic
    (``topic=...``) or, as JSON lines, to a folder."""
    columns = [c for c in ("key", "value", "timestamp") if c in messages.columns]
    writer = messages.select(*columns).writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path) if path else writer.start()
