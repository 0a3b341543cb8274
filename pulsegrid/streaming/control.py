"""From the event topic to audit records, decided by a clock.

Two streams share a feature store. The topic's stream decodes messages, sets the malformed ones aside, and adds a vector
per event to the store. The clock's stream has a row per tick; each of its micro-batches scores, for every service, the newest vector of
the last three minutes. So a cycle without new events is decided like any other, until the newest vector is too old,
and neither stream waits for the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators import decisions as D
from pulsegrid.operators.asof import asof_join
from pulsegrid.schema import FEATURE_COLS, FEATURE_VECTOR
from pulsegrid.session import materialise
from pulsegrid.sources.events import decode, split_malformed
from pulsegrid.streaming.features import feature_batch
from pulsegrid.streaming.scoring import CYCLE_SECONDS, decision_cycle
from pulsegrid.streaming.state import StateTable, write_batch

LOOKBACK = 180  # fixed value: seconds that a vector can be scored
MICROS = 1_000_000
STORED = T.StructType([T.StructField("event_id", T.LongType()), *FEATURE_VECTOR.fields, T.StructField("day", T.DateType())])


# -- topic to store ------------------------------------------------------------------------------

def store_vectors(store: str) -> Callable[[DataFrame, int], None]:
    """Adds the vectors of a micro-batch to a table partitioned by day; a replay overwrites its own part."""
    def write(vectors: DataFrame, batch_id: int) -> None:
        dated = vectors.select("event_id", "endpoint", "timestamp", *FEATURE_COLS).withColumns(
            {"day": F.to_date("timestamp"), "batch_id": F.lit(batch_id)})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(store)

    return write


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The stored vectors; none while nothing has been stored."""
    try:
        return spark.read.schema(T.StructType([*STORED.fields, T.StructField("batch_id", T.IntegerType())])).parquet(store).drop("batch_id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORED)


def topic_batch(vectors: str, store: str, state: str, *, quarantine: str | None = None,
                **options) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function for messages (``event_id, value, record_time``): vectors to ``vectors`` and the
    ``store``, malformed messages to ``quarantine``."""
    featured = feature_batch(vectors, state, sink=store_vectors(store), **options)

    def run(batch: DataFrame, batch_id: int) -> None:
        # parsed once, read by both; of a usable message only the event is kept
        kept = decode(batch).withColumn("value", F.when(F.col("malformed"), F.col("value")))
        good, malformed = split_malformed(materialise(kept.select("event_id", "ts", "endpoint", "latency_ms", "malformed", "value", "record_time")))
        if quarantine is not None:
            write_batch(malformed.select("event_id", "value", "record_time"), quarantine, batch_id)
        featured(good, batch_id)

    return run


def start_topic_stream(messages: DataFrame, vectors: str, store: str, state: str, checkpoint: str, *, quarantine: str | None = None,
                       available_now: bool = False, interval: str = "5 seconds", **options) -> StreamingQuery:
    """``messages`` is what :func:`pulsegrid.sources.events.event_stream` gives."""
    writer = messages.writeStream.foreachBatch(topic_batch(vectors, store, state, quarantine=quarantine, **options)) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


# -- clock to audit ------------------------------------------------------------------------------

def clock(spark: SparkSession) -> DataFrame:
    """A stream with the time, one row a second, whether or not there are events."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("tick"))


def cycle_of(tick: Column, seconds: int = CYCLE_SECONDS) -> Column:
    return F.floor(F.unix_micros(tick) / F.lit(seconds * MICROS))


def due_vectors(vectors: DataFrame, cycles: DataFrame, *, key: str = "endpoint", ts: str = "timestamp", tie: Sequence[str] = ("event_id",),
                seconds: int = CYCLE_SECONDS, lookback: int = LOOKBACK) -> DataFrame:
    """One row per cycle of ``cycles`` (column ``cycle``) and service that has a vector at most ``lookback`` seconds old
    when the cycle begins: its newest vector, with ``service``, and the begin of the cycle as ``timestamp``.

    Vectors are reduced to the newest of each cycle before anything else, so a busy service costs one row a cycle.
    A NULL service is one too; vectors without time are never due. Of vectors with one time the last by ``tie`` is taken.
    """
    width = F.lit(seconds * MICROS)
    at = F.unix_micros(ts)
    rest = [c for c in vectors.columns if c not in (key, ts)]
    # one row per service and cycle, read by the cycles, the join and its carry table: written down once
    newest = materialise(vectors.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("service"), F.ceil(at / width).alias("_cycle")).agg(
        F.max_by(F.struct(F.col(ts).alias("_at"), *rest), F.struct(ts, *tie)).alias("_v")).select("service", "_cycle", "_v.*"))
    last = F.floor((F.unix_micros("_at") + F.lit(lookback * MICROS)) / width)
    # keys alone are repeated, at most lookback / seconds + 1 times
    wanted = newest.where(last >= F.col("_cycle")).select("service", F.explode(F.sequence("_cycle", last)).alias("cycle")).distinct()
    wanted = wanted.join(cycles.select("cycle").distinct(), "cycle").select(
        "service", F.timestamp_micros(F.col("cycle") * width).alias("timestamp"))
    return asof_join(wanted, newest, ["service"], ts="timestamp", right_ts="_at", values=rest, tie=list(tie), tolerance=lookback)


def scheduled_decisions(vectors: DataFrame, cycles: DataFrame, predict: Callable[[DataFrame], DataFrame], *, seconds: int = CYCLE_SECONDS,
                        lookback: int = LOOKBACK, tie: Sequence[str] = ("event_id",), key: str = "endpoint", ts: str = "timestamp",
                        state: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """``(audit records, policy outcome)`` of all cycles at once: the replay of what :func:`start_scheduler` decides."""
    due = due_vectors(vectors, cycles, key=key, ts=ts, tie=tie, seconds=seconds, lookback=lookback)
    return decision_cycle(due, predict, seconds=seconds, state=state, **options)


def tick_batch(store: str, audit: str, state: str, predict: Callable[[DataFrame], DataFrame], *, seconds: int = CYCLE_SECONDS,
               lookback: int = LOOKBACK, **options) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function for ticks (column ``tick``). Every cycle is decided once, however many ticks fall
    into it; of the store only the days of these cycles are read."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        policy, decided = StateTable(spark, state, "policy"), StateTable(spark, state, "clock")
        before, clocked = policy.before(batch_id), decided.before(batch_id)
        cycles = materialise(batch.where(F.col("tick").isNotNull()).select(cycle_of(F.col("tick"), seconds).alias("cycle")).distinct())
        done = clocked.first()["cycle"] if clocked is not None else None  # a single row
        if done is not None:
            cycles = cycles.where(F.col("cycle") > F.lit(done))
        span = cycles.agg(F.min("cycle").alias("lo"), F.max("cycle").alias("hi")).first()
        vectors = read_store(spark, store)
        if span["lo"] is None:
            vectors = vectors.limit(0)
        else:
            oldest, newest = (F.timestamp_micros(F.lit(c * seconds * MICROS)) for c in (span["lo"], span["hi"]))
            oldest = oldest - F.make_dt_interval(secs=F.lit(lookback))
            vectors = vectors.where(F.col("day").between(F.to_date(oldest), F.to_date(newest)) & F.col("timestamp").between(oldest, newest))
        records, outcome = scheduled_decisions(vectors.drop("day"), cycles, predict, seconds=seconds, lookback=lookback, state=before, **options)
        write_batch(records, audit, batch_id)
        fresh = D.policy_state(outcome)
        if before is not None:
            fresh = before.join(fresh, "service", "left_anti").unionByName(fresh)
        policy.after(batch_id, fresh)
        upto = span["hi"] if span["hi"] is not None else done
        decided.after(batch_id, spark.createDataFrame([(upto,)], "cycle long"))

    return run


def start_scheduler(ticks: DataFrame, store: str, audit: str, state: str, checkpoint: str, predict: Callable[[DataFrame], DataFrame], *,
                    available_now: bool = False, seconds: int = CYCLE_SECONDS, **options) -> StreamingQuery:
    """``ticks`` is :func:`clock`, or any stream with a column ``tick``."""
    writer = ticks.writeStream.foreachBatch(tick_batch(store, audit, state, predict, seconds=seconds, **options)) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()
