"""Periodic scoring: newest vector per service and cycle -> prediction -> gate -> policy -> audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators import decisions as D
from pulsegrid.session import materialise
from pulsegrid.streaming.state import StateTable, write_batch

CYCLE_SECONDS = 5  # fixed value


def decision_cycle(vectors: DataFrame, predict: Callable[[DataFrame], DataFrame], *, service: str = "service",
                   ts: str = "timestamp", tie: Sequence[str] = (), seconds: int = CYCLE_SECONDS,
                   threshold: float = D.CONFIDENCE_THRESHOLD, min_rate: float = D.MIN_RATE,
                   limits: D.PolicyLimits = D.PolicyLimits(),
                   state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(audit records, policy outcome)`` for a table of vectors: a replay over history when given
    everything, one step of the stream when given a micro-batch. ``predict`` adds ``main, lower,
    upper``."""
    newest = D.newest_per_cycle(vectors.withColumnRenamed(service, "service"), seconds=seconds, ts=ts, tie=tie)
    gated = D.gate(D.score(predict(newest), threshold=threshold), threshold=threshold, min_rate=min_rate)
    gated = gated.withColumnRenamed(ts, "timestamp") if ts != "timestamp" else gated
    # scored once; the policy and the audit record both read it
    gated = materialise(gated.select("service", "timestamp", "predicted_rate", "confidence", "action_type", "reason"))
    outcome = materialise(D.scaling_policy(gated.filter(F.col("action_type") == D.DISPATCH), limits, state=state))
    return D.decision_records(gated, outcome), outcome


def scoring_batch(audit: str, state: str, predict: Callable[[DataFrame], DataFrame],
                  **options) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, state, "policy")
        cycles = StateTable(batch.sparkSession, state, "cycles")
        before, decided = table.before(batch_id), cycles.before(batch_id)
        service, ts = options.get("service", "service"), options.get("ts", "timestamp")
        cycle = F.floor(F.unix_seconds(ts) / F.lit(options.get("seconds", CYCLE_SECONDS)))
        stamped = batch.withColumn("_cycle", cycle)
        if decided is not None:  # a cycle is decided once, also where a micro-batch cuts it
            last = decided.select(F.col("service").alias(service), F.col("cycle").alias("_last"))
            stamped = stamped.join(last, service, "left").filter(F.col("_last").isNull() | (F.col("_cycle") > F.col("_last"))).drop("_last")
        records, outcome = decision_cycle(stamped.drop("_cycle"), predict, state=before, **options)
        write_batch(records, audit, batch_id)
        fresh = D.policy_state(outcome)
        if before is not None:
            fresh = before.join(fresh, "service", "left_anti").unionByName(fresh)
        table.after(batch_id, fresh)
        ends = stamped.groupBy(F.col(service).alias("service")).agg(F.max("_cycle").alias("cycle"))
        ends = ends if decided is None else decided.unionByName(ends).groupBy("service").agg(F.max("cycle").alias("cycle"))
        cycles.after(batch_id, ends)

    return run


def start_scoring_stream(vectors: DataFrame, predict, audit: str, state: str, checkpoint: str, *,
                         available_now: bool = False, **options) -> StreamingQuery:
    writer = vectors.writeStream.foreachBatch(scoring_batch(audit, state, predict, **options)) \
        .option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{CYCLE_SECONDS} seconds"}
    return writer.trigger(**trigger).start()
