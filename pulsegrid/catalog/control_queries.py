"""From the event topic to audit records: the streams of a running system, and their replay in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.decision_queries import _ACYCLE, _AUDIT_SELECT, AUDIT_SQL, PRED_SQL
from pulsegrid.catalog.inputs import request_events, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.stream_features import vector_sql
from pulsegrid.plans import event_features as ef
from pulsegrid.session import scratch, use_utc
from pulsegrid.sources import events as E
from pulsegrid.streaming import control

ROUNDS = 3  # stretches of time in which messages arrive and the clock ticks by turns
CYCLE = control.CYCLE_SECONDS


def requests(spark, sf):
    """API requests on the fast clock."""
    ev = request_events(spark, sf, compress=True)
    return ev.withColumns({"path": F.concat(F.lit("/api/"), "endpoint"), "latency_ms": F.round("latency_ms")})


def topic(spark, sf, arrived=None):
    """The requests as records of a topic with one partition, and a broken message after every fiftieth of them. ``arrived`` tells
    from the time of a request whether to take it: others are left out before a message is written."""
    given = requests(spark, sf)
    if arrived is not None:
        given = given.where(arrived(F.col("ts")))
    # dealt anew, as a stretch of time may lie in a few parts of the log only
    sent = E.messages(given.repartition("event_id").withColumn("status", F.col("status").cast("int")))
    time = F.timestamp_millis(F.get_json_object("value", "$.ts").cast("long"))
    good = F.struct(F.lit(0).alias("partition"), "value")
    broken = F.struct(F.lit(1).alias("partition"), F.lit('{"ts":').alias("value"))
    records = sent.select(F.col("event_id").alias("offset"), "key", time.alias("timestamp"), F.explode(
        F.when(F.col("event_id") % 50 == 0, F.array(good, broken)).otherwise(F.array(good))).alias("_r"))
    return records.select("_r.partition", "offset", "key", "_r.value", "timestamp")


def predict(vectors):
    """Stand-in for a model that SQL can follow: load and bounds from the requests of the last minute."""
    n = F.floor(F.col("req_rate_1m") * 60 + 0.5)
    main = n * 40.0 + 3.0
    return vectors.withColumns({"main": main, "lower": main * 0.95, "upper": main * 1.05 + n % 4 * 30.0})


SCHEDULE_SQL = f"""vec AS (SELECT '/api/' || endpoint AS service, timestamp, event_id, CAST(floor(req_rate_1m * 60 + 0.5) AS BIGINT) AS n FROM ({vector_sql()})),
  newest AS (SELECT service, timestamp AS since, arg_max(n, event_id) AS n FROM vec GROUP BY ALL),
  ticks AS (SELECT service, unnest(range(min(epoch_us(timestamp)) // {CYCLE * 1_000_000}, max(epoch_us(timestamp)) // {CYCLE * 1_000_000} + {control.LOOKBACK // CYCLE + 2})) * {CYCLE} AS s
    FROM vec GROUP BY service),
  due AS (SELECT t.service, epoch_ms(t.s * 1000) AS timestamp, since, n FROM ticks t ASOF JOIN newest m ON t.service = m.service AND epoch_ms(t.s * 1000) >= m.since),
  pred AS (SELECT service, timestamp, n * 40.0::DOUBLE + 3.0::DOUBLE AS main, (n * 40.0::DOUBLE + 3.0::DOUBLE) * 0.95::DOUBLE AS lower,
      (n * 40.0::DOUBLE + 3.0::DOUBLE) * 1.05::DOUBLE + n % 4 * 30.0::DOUBLE AS upper
    FROM due WHERE epoch_us(timestamp) - epoch_us(since) <= {control.LOOKBACK * 1_000_000})"""
_EVERY = """ag AS (SELECT * FROM gated),
  seq AS (SELECT service, timestamp, main AS rate, epoch_us(timestamp) // 1000000 AS s,
    row_number() OVER (PARTITION BY service ORDER BY timestamp) AS rn FROM ag WHERE action_type = 'DISPATCH')"""
CONTROL_SQL = f"WITH RECURSIVE {AUDIT_SQL.replace(PRED_SQL, SCHEDULE_SQL).replace(_ACYCLE, _EVERY)} SELECT {_AUDIT_SELECT} FROM audit"


def _edges(spark, sf):
    """The cycles between the first event and the end of the last vector's time, cut into rounds."""
    first, last = requests(spark, sf).agg(F.min(control.cycle_of(F.col("ts"))), F.max(control.cycle_of(F.col("ts")))).first()
    end = last + control.LOOKBACK // CYCLE + 2
    return [first + (end - first) * k // ROUNDS for k in range(ROUNDS + 1)]


@query("t16_scheduled_replay", CONTROL_SQL)
def t16(spark, sf):
    """All vectors and all ticks in one batch."""
    vectors = ef.feature_vectors(requests(spark, sf).withColumn("endpoint", F.col("path")))
    lo, *_, hi = _edges(spark, sf)
    records, _ = control.scheduled_decisions(vectors, spark.range(lo, hi).withColumnRenamed("id", "cycle"), predict)
    return tidy(records)


def run_system(spark, sf, model=predict) -> dict[str, str]:
    """Messages arrive and the clock ticks in turns; both streams stop after each turn and start again from their checkpoints."""
    use_utc(spark)
    at = {n: scratch(spark, n) for n in ("topic", "ticks", "vectors", "store", "features", "quarantine", "audit", "scheduler", "cp1", "cp2")}
    edges = _edges(spark, sf)
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        def arrived(ts, k=k, lo=lo, hi=hi):
            # an event at the very begin of a cycle is seen by it: rounds end just after a tick
            within = (F.unix_micros(ts) > F.lit((lo - 1) * CYCLE * control.MICROS)) & (F.unix_micros(ts) <= F.lit((hi - 1) * CYCLE * control.MICROS))
            return within if k else within | (control.cycle_of(ts) < lo)

        topic(spark, sf, arrived).write.mode("append").parquet(at["topic"])
        stream = E.event_stream(spark, "parquet", at["topic"], schema=E.TOPIC_ARCHIVE)
        done = control.start_topic_stream(stream, at["vectors"], at["store"], at["features"], at["cp1"], quarantine=at["quarantine"], available_now=True)
        done.awaitTermination()
        spark.range(lo, hi, 1, 1).select(F.timestamp_seconds(F.col("id") * CYCLE).alias("tick")).write.mode("append").parquet(at["ticks"])
        ticks = spark.readStream.schema("tick timestamp").parquet(at["ticks"])
        done = control.start_scheduler(ticks, at["store"], at["audit"], at["scheduler"], at["cp2"], model, available_now=True)
        done.awaitTermination()
    return at


@query("t16b_topic_to_audit", CONTROL_SQL)
def t16b(spark, sf):
    return tidy(spark.read.parquet(run_system(spark, sf)["audit"]).drop("batch_id"))
