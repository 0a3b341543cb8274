"""Request-event source: tolerant decoding, quarantine, and the producer's message form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.web import API_PREFIX

# Field fallbacks of the event message, in the order they are tried.
LATENCY_FIELDS = ("latency_ms", "latency_avg", "latency")
DEFAULT_LATENCY = 10.0
DEFAULT_ENDPOINT = "unknown"
MESSAGE_FIELDS = ("ts", "endpoint", "method", "client_id", "latency_ms", "status", "bytes_sent")

OFFSET_BITS = 44  # 2^44 records to a partition
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


TOPIC_ARCHIVE = "partition int, offset long, key string, value string, timestamp timestamp"


def event_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None, *, schema: str | None = None, **options: str) -> DataFrame:
    """Streaming ``(event_id, value, record_time)`` from a topic (``subscribe=...``), a folder of JSON lines (``text``), or a
    topic's records kept as files (``parquet`` with ``schema=TOPIC_ARCHIVE``).

    A topic's ids come from partition and offset, which order the records of a client and never change; a
    record of a folder has the hash of its file and text.
    """
    reader = spark.readStream.format(fmt).options(**options)
    reader = reader.schema(schema) if schema else reader
    raw = reader.load(path) if path else reader.load()
    time = F.col("timestamp") if "timestamp" in raw.columns else F.current_timestamp()
    value = F.col("value").cast("string")
    if {"partition", "offset"} <= set(raw.columns):
        event_id = F.shiftleft(F.col("partition").cast("long"), OFFSET_BITS) + F.col("offset")
    else:
        event_id = F.xxhash64(F.input_file_name(), value)
    return raw.select(event_id.alias("event_id"), value.alias("value"), time.alias("record_time"))


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def decode(df: DataFrame, value: str = "value", record_time: str = "record_time") -> DataFrame:
    """Parse event messages, keeping every row: adds the event columns and ``malformed``.

    Time comes from a textual ISO ``timestamp``, else ``ts`` in epoch milliseconds, else the record
    itself. A message that is no JSON, or whose textual timestamp is no instant, is malformed.
    """
    v = F.col("_v")
    # exploding a one-element array keeps the row and pins the parse: a filter on the result cannot
    # copy it below, so each message is parsed once
    parsed = df.withColumn("_v", F.explode(F.array(F.try_parse_json(value))))
    stamp = _get(v, "timestamp", "variant")
    textual = F.coalesce(F.schema_of_variant(stamp) == "STRING", F.lit(False))
    text = _get(v, "timestamp", "string")
    instant = F.when(text.rlike(INSTANT), text.try_cast("timestamp"))
    millis = F.coalesce(_get(v, "ts", "bigint"), F.lit(0).cast("long"))
    ts = (
        F.when(textual, instant)
        .when(_get(v, "ts", "variant").isNotNull(), F.timestamp_millis(millis))
        .otherwise(F.col(record_time)))
    latency = F.lit(DEFAULT_LATENCY)
    for name in reversed(LATENCY_FIELDS):
        number = F.coalesce(_get(v, name, "double"), F.lit(0.0))
        latency = F.when(_get(v, name, "variant").isNotNull(), number).otherwise(latency)
    return parsed.withColumns({
        "malformed": v.isNull() | (textual & instant.isNull()),
        "endpoint": F.coalesce(_get(v, "endpoint", "string"), F.lit(DEFAULT_ENDPOINT)),
        "ts": ts,
        "latency_ms": latency,
        "method": _get(v, "method", "string"),
        "client_id": _get(v, "client_id", "string"),
        "status": _get(v, "status", "int"),
        "bytes_sent": _get(v, "bytes_sent", "bigint"),
    }).drop("_v")


def split_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable events, and the messages to keep aside."""
    good = decoded.filter(~F.col("malformed")).drop("malformed")
    return good, decoded.filter("malformed")


def messages(requests: DataFrame, *, path: str = "path") -> DataFrame:
    """Producer form ``(key, value)`` of a request log: keyed by client, API requests that passed
    authentication and the limiter only."""
    passed = F.col(path).startswith(API_PREFIX)
    for flag in ("authenticated", "allowed"):
        if flag in requests.columns:
            passed = passed & F.col(flag)
    payload = F.struct(
        F.unix_millis("ts").alias("ts"), F.col(path).alias("endpoint"), "method", "client_id",
        F.col("latency_ms").cast("long").alias("latency_ms"), F.col("status").cast("int").alias("status"),
        F.col("bytes_sent").cast("long").alias("bytes_sent"))
    return requests.filter(passed).select(
        *[c for c in ("event_id",) if c in requests.columns],
        F.col("client_id").alias("key"), F.to_json(payload).alias("value"))
