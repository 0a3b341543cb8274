"""From predictions to gated scaling decisions and their audit records."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.schema import AUDIT_COLS, FEATURE_COLS

# Thresholds of scoring and gate.
CONFIDENCE_THRESHOLD = 0.75
MIN_RATE = 20.0
DISPATCH, HOLD = "DISPATCH", "HOLD"
# Bands of the anomaly score as written, and the early heuristics.
ANOMALY_BANDS = ((-0.1, "anomaly"), (-0.2, "suspicious"))
HEURISTIC_FACTOR, HEURISTIC_SCALE_UP, HEURISTIC_ANOMALY = 1.2, 100.0, 50.0


# -- feature vectors -----------------------------------------------------------------------------

def check_feature_columns(columns: Sequence[str]) -> None:
    """Exactly the 26 features; names the first problem."""
    if len(columns) != len(FEATURE_COLS):
        raise ValueError(f"expected exactly {len(FEATURE_COLS)} features, got {len(columns)}")
    for name in FEATURE_COLS:
        if name not in columns:
            raise ValueError(f"missing feature: {name}")


def validate_features(df: DataFrame, features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """Adds ``violation``: the first feature, in canonical order, that is missing, NaN or infinite."""
    def problem(name: str) -> Column:
        c = F.col(name)
        kind = F.when(c.isNull(), "missing").when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), "infinite")
        return F.concat(F.lit(name + ": "), kind)

    return df.withColumn("violation", F.coalesce(*[problem(c) for c in features]))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (validated.filter(F.col("violation").isNull()).drop("violation"),
            validated.filter(F.col("violation").isNotNull()))


def feature_array(df: DataFrame, out: str = "features") -> DataFrame:
    """The features as one array in canonical order; absent or non-numeric values are 0."""
    present = set(df.columns)
    items = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in present else F.lit(0.0) for c in FEATURE_COLS]
    return df.withColumn(out, F.array(*items))


# -- scoring and gate ----------------------------------------------------------------------------

def score(df: DataFrame, *, main: str = "main", lower: str = "lower", upper: str = "upper",
          threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Adds prediction, bounds, confidence in [0, 1] and the suggested action."""
    m, lo, hi = (F.when(~F.isnan(c), F.col(c)) for c in (main, lower, upper))
    spread = (hi - lo) / F.greatest(m, F.lit(1.0))
    raw = F.lit(1.0) - spread
    confidence = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return df.withColumns({
        "predicted_rate": m, "lower_bound": lo, "upper_bound": hi, "confidence": confidence,
        "action": F.when(confidence >= threshold, DISPATCH).otherwise(HOLD),
        "threshold_used": F.lit(float(threshold)),
    })


def gate(df: DataFrame, *, threshold: float = CONFIDENCE_THRESHOLD, min_rate: float = MIN_RATE) -> DataFrame:
    """Adds ``action_type`` and ``reason``; the rate is looked at first."""
    low, sure = F.col("predicted_rate") < min_rate, F.col("confidence") >= threshold
    return df.withColumns({
        "action_type": F.when(low, HOLD).when(sure, DISPATCH).otherwise(HOLD),
        "reason": F.when(low, "prediction_too_low").when(sure, "confidence_met").otherwise("below_threshold"),
    })


def anomaly_band(value: Column) -> Column:
    """Label by the bands as written: higher is worse."""
    (bad, first), (odd, second) = ANOMALY_BANDS
    return F.when(value > bad, first).when(value > odd, second).otherwise("normal")


def heuristics(df: DataFrame, rate: str = "req_rate_1m", change: str = "rate_of_change") -> DataFrame:
    """Development stand-ins for the models."""
    load, score_ = F.col(rate) * HEURISTIC_FACTOR, F.abs(F.col(change)) * 10.0
    return df.withColumns({
        "predicted_load": load,
        "heuristic_action": F.when(load > HEURISTIC_SCALE_UP, "SCALE_UP").otherwise("MAINTAIN"),
        "anomaly_score": score_, "is_anomaly": score_ > HEURISTIC_ANOMALY,
    })


# -- scaling policy ------------------------------------------------------------------------------

@dataclass(frozen=True)
class PolicyLimits:
    """The policy's default bounds."""

    min_replicas: int = 1
    max_replicas: int = 6
    cooldown: int = 60
    max_step: int = 2
    out_rate: float = 500.0
    in_rate: float = 200.0
    in_delay: int = 120


@dataclass(frozen=True)
class PolicyState:
    """Replicas, second of the last action, and since when the rate has been low."""

    replicas: int = 1
    acted: int | None = None
    low_since: int | None = None


def _whole(x: float) -> str:
    return str(math.floor(x + 0.5))


def policy_step(state: PolicyState, second: int, rate: float,
                limits: PolicyLimits = PolicyLimits()) -> tuple[PolicyState, str, int, str]:
    """One prediction: ``(new state, action, target replicas, reason)``. A started action counts as
    carried out. The low-rate timer is left alone while cooling down and while the rate is high."""
    now = state.replicas
    if state.acted is not None and second - state.acted < limits.cooldown:
        left = limits.cooldown - (second - state.acted)
        return state, "COOLDOWN", now, f"cooldown_active ({left}s remaining)"
    if rate > limits.out_rate:
        wanted = min(max(math.ceil(rate / limits.out_rate), limits.min_replicas), limits.max_replicas)
        target = min(now + min(wanted - now, limits.max_step), limits.max_replicas)
        if target > now:
            why = f"predicted_rate={_whole(rate)} > threshold={_whole(limits.out_rate)}"
            return PolicyState(target, second, None), "SCALE_OUT", target, why
        return state, HOLD, now, f"at_max_replicas ({limits.max_replicas})"
    if not (rate < limits.in_rate and now > limits.min_replicas):
        return replace(state, low_since=None), HOLD, now, "within_thresholds"
    if state.low_since is None:
        return replace(state, low_since=second), HOLD, now, "scale_in_delay_started"
    waited = second - state.low_since
    if waited < limits.in_delay:
        return state, HOLD, now, f"scale_in_pending ({limits.in_delay - waited}s remaining)"
    target = max(now - limits.max_step, limits.min_replicas)
    why = f"predicted_rate={_whole(rate)} < threshold={_whole(limits.in_rate)} for {waited}s"
    return PolicyState(target, second, None), "SCALE_IN", target, why


STATE_COLS = ("replicas", "acted", "low_since")


def _restore(row: pd.Series) -> PolicyState:
    replicas, acted, low = (None if pd.isna(v) else int(v) for v in row)
    return PolicyState() if replicas is None else PolicyState(replicas, acted, low)


def policy_state(outcome: DataFrame) -> DataFrame:
    """State of each service after its last row."""
    last = outcome.groupBy("service").agg(F.max_by(F.struct(*STATE_COLS), "timestamp").alias("_s"))
    return last.select("service", "_s.*")


POLICY_SCHEMA = ("service string, timestamp timestamp, predicted_rate double, scale_action string, "
                 "current_replicas int, target_replicas int, scale_reason string, "
                 "replicas int, acted long, low_since long")


def newest_per_cycle(df: DataFrame, key: str = "service", *, seconds: int = 5, ts: str = "timestamp",
                     tie: Sequence[str] = ()) -> DataFrame:
    """The last row of every cycle: what a scheduler ticking every ``seconds`` would pick up. Leaves
    at most one row per key and cycle, however many rows the key has."""
    cycle = F.floor(F.unix_seconds(ts) / F.lit(seconds))
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key, cycle.alias("_cycle")).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scaling_policy(dispatched: DataFrame, limits: PolicyLimits = PolicyLimits(), *,
                   order: Sequence[str] = ("timestamp",), state: DataFrame | None = None) -> DataFrame:
    """Run the policy over each service's predictions in time order.

    Inherently sequential per service, so input is expected at scheduler cadence (see
    :func:`newest_per_cycle`); rows stream through in sorted batches and only the state is kept.
    ``state`` continues an earlier run (see :func:`policy_state`).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            if now is None:
                now = _restore(b[["_replicas", "_acted", "_low_since"]].iloc[0])
            out = b[["service", "timestamp", "predicted_rate"]].copy()
            rows = []
            for second, rate in zip(b["second"].tolist(), b["predicted_rate"].tolist()):
                before = now.replicas
                now, action, target, reason = policy_step(now, second, rate, limits)
                rows.append((action, before, target, reason, now.replicas, now.acted, now.low_since))
            names = ["scale_action", "current_replicas", "target_replicas", "scale_reason", *STATE_COLS]
            out[names] = pd.DataFrame(rows, index=out.index, columns=names)
            yield out.astype({"acted": "Int64", "low_since": "Int64"})

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    extra = [c for c in order if c not in ("timestamp",)]
    rows = dispatched.select("service", "timestamp", "predicted_rate", F.unix_seconds("timestamp").alias("second"), *extra)
    if state is None:
        rows = rows.withColumns({"_replicas": F.lit(None).cast("int"), "_acted": F.lit(None).cast("long"),
                                 "_low_since": F.lit(None).cast("long")})
    else:
        rows = rows.join(state.select("service", *[F.col(c).alias("_" + c) for c in STATE_COLS]), "service", "left")
    ordered = rows.repartition("service").sortWithinPartitions("service", *order)
    return ordered.groupBy("service").applyInPandas(run, POLICY_SCHEMA)


def decision_records(gated: DataFrame, policy: DataFrame | None = None, *, mode: str = "local") -> DataFrame:
    """Audit rows: dispatched predictions carry the policy's outcome, held ones HOLD and zeros."""
    base = gated.withColumns({
        "duration_ms": F.lit(0).cast("long"), "provisioning_latency_ms": F.lit(0).cast("long")})
    sent = F.col("action_type") == DISPATCH
    if policy is None:
        joined = base.withColumns({
            "_a": F.lit(None).cast("string"), "_c": F.lit(None).cast("int"), "_t": F.lit(None).cast("int")})
    else:
        outcome = policy.select("service", "timestamp", F.col("scale_action").alias("_a"),
                                F.col("current_replicas").alias("_c"), F.col("target_replicas").alias("_t"))
        joined = base.join(outcome, ["service", "timestamp"], "left")
    return joined.withColumns({
        "scale_action": F.when(sent, F.coalesce("_a", F.lit(HOLD))).otherwise(HOLD),
        "desired_replicas": F.when(sent, F.coalesce("_t", F.lit(0))).otherwise(0),
        # a started action is taken as carried out
        "actual_replicas": F.when(sent, F.coalesce("_t", F.lit(0))).otherwise(0),
        "scaler_mode": F.when(sent, F.lit(mode)),
    }).select(*AUDIT_COLS)
