"""The given tables, viewed the way the operators expect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import q6
from pulsegrid.session import use_utc

BASE_MS = 1_704_067_200_000  # 2024-01-01, the first day of the events table
SPEEDUP = 600  # compresses the sparse test timeline so that minute windows fill up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def request_events(spark: SparkSession, sf_dir: str, *, compress: bool = False) -> DataFrame:
    """The events table as request events; ``compress`` speeds its clock up."""
    df = raw_events(spark, sf_dir)
    ts = F.col("ts")
    if compress:
        ts = F.timestamp_millis(F.lit(BASE_MS) + F.floor((F.unix_millis("ts") - BASE_MS) / F.lit(SPEEDUP)))
    return df.select(
        "event_id", ts.alias("ts"), F.col("event_type").alias("endpoint"), F.lit("GET").alias("method"),
        F.col("user_id").cast("string").alias("client_id"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.length("props").cast("long").alias("bytes_sent"))


# The same two views in SQL.
EV_SQL = """ev AS (
  SELECT event_id, ts, event_type AS endpoint, 'GET' AS method, CAST(user_id AS VARCHAR) AS client_id,
         value AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         length(props) AS bytes_sent
  FROM events)"""
EVC_SQL = f"""ev AS (
  SELECT event_id, ts, event_type AS endpoint, CAST(user_id AS VARCHAR) AS client_id, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, ms, ms // 1000 AS sec
  FROM (SELECT * EXCLUDE (ts), epoch_ms(ms) AS ts
        FROM (SELECT *, {BASE_MS} + (epoch_us(ts) // 1000 - {BASE_MS}) // {SPEEDUP} AS ms FROM events)))"""


def ntz(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def tidy(df: DataFrame) -> DataFrame:
    """Result form: six decimals, UTC wall-clock timestamps."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = q6(c.cast("double"))
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def r6(expr: str) -> str:
    """SQL twin of the rounding in :func:`tidy`."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE"
