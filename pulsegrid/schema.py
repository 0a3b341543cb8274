"""Column contracts shared by the batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# The 26 feature names, in the order every consumer relies on.
FEATURE_COLS = [
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "week_of_year",
    "is_weekend", "is_holiday", "day_of_month", "req_rate_1m", "req_rate_5m",
    "req_rate_15m", "req_rate_30m", "latency_std_5m", "latency_std_15m",
    "req_max_5m", "req_max_15m", "ewma_03", "ewma_07", "rate_of_change",
    "autocorr_lag1", "cpu_util", "memory_pressure", "active_connections",
    "cache_hit_ratio", "replica_count", "queue_depth",
]

# The two labels of the training table.
LABEL_COLS = ["future_req_rate_5m", "is_surge"]

REQUEST_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("bytes_sent", T.LongType()),
])

FEATURE_VECTOR = T.StructType(
    [T.StructField("endpoint", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLS]
)

SERIES = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

AUDIT_COLS = [
    "timestamp", "service", "action_type", "confidence", "predicted_rate", "reason",
    "duration_ms", "desired_replicas", "actual_replicas", "provisioning_latency_ms",
    "scaler_mode", "scale_action",
]
