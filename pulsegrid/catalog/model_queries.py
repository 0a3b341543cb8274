"""M-01..M-03, M-08, M-09: splits, forecaster, anomaly model on the per-minute training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import r6, tidy
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.rolling_queries import SER, minutes
from pulsegrid.operators import decisions as D
from pulsegrid.operators import models as ML
from pulsegrid.plans.training import build_features, surge_flags
from pulsegrid.session import materialise

SPLIT_SQL = f"""{SER}, t AS (SELECT timestamp, idx, r, idx < CAST(floor((SELECT count(*) FROM m) * 0.8::DOUBLE) AS BIGINT) AS is_train FROM m)"""


@query("m01_chronological_split", f"WITH {SPLIT_SQL} SELECT timestamp, {r6('r')} AS req_rate_1m, is_train FROM t")
def m01(spark, sf):
    return tidy(ML.chronological_split(materialise(minutes(spark, sf))).select("timestamp", "req_rate_1m", "is_train"))


@query("m02_normal_traffic", f"""WITH {SPLIT_SQL}
  SELECT timestamp, {r6('r')} AS req_rate_1m FROM t WHERE is_train
    AND r <= 3 * (SELECT median(r) FROM t WHERE is_train) AND NOT r > greatest(1, 3 * (SELECT median(r) FROM m))""")
def m02(spark, sf):
    flagged = materialise(surge_flags(materialise(minutes(spark, sf))))
    train = ML.chronological_split(flagged).filter("is_train")
    return tidy(ML.normal_traffic(train).select("timestamp", "req_rate_1m"))


def _training(spark, sf):
    # trained on and scored several times: written down once
    return materialise(ML.chronological_split(build_features(minutes(spark, sf))))


ROUNDS = 10  # of the 200 that fit_forecaster trains by default, at its full depth; the README has the time of all
_MODELS: dict = {}


def _forecast(spark, sf):
    """The held-out rows with the forecast of a model that a session trains once on its tables, for all queries."""
    key = spark.sparkContext.applicationId, sf
    if key not in _MODELS:
        t = _training(spark, sf)
        _MODELS[key] = t, ML.fit_forecaster(t.filter("is_train"), trees=ROUNDS)
    t, model = _MODELS[key]
    return model.predict(t.filter("not is_train"))


@query("m03_load_forecast")
def m03(spark, sf):
    scored = D.gate(D.score(_forecast(spark, sf)))
    return tidy(scored.select("timestamp", "predicted_rate", "lower_bound", "upper_bound", "confidence", "action_type"))


@query("m03b_forecast_error")
def m03b(spark, sf):
    return tidy(ML.forecast_error(_forecast(spark, sf)))


@query("m03c_forecast_bounds", f"""WITH {SPLIT_SQL}, f AS (
    SELECT timestamp, is_train, coalesce(lead(r, 5) OVER (ORDER BY timestamp), (SELECT arg_max(r, timestamp) FROM t)) AS future FROM t)
  SELECT timestamp, {r6('future')} AS future_req_rate_5m, true AS bounds_enclose FROM f WHERE NOT is_train""")
def m03c(spark, sf):
    enclosed = F.col("main").between(F.col("lower"), F.col("upper"))
    return tidy(_forecast(spark, sf).select("timestamp", "future_req_rate_5m", enclosed.alias("bounds_enclose")))


def _forest(t):
    return ML.fit_isolation_forest(ML.normal_traffic(t.filter("is_train")), "timestamp")


@query("m08b_isolation_scores")
def m08b(spark, sf):
    t = _training(spark, sf)
    out = _forest(t).predict(t.filter("not is_train"))
    return tidy(out.select("timestamp", "anomaly_score", "is_anomaly",
                           D.anomaly_band(F.col("anomaly_score")).alias("band_as_written")))


@query("m09_anomaly_evaluation")
def m09(spark, sf):
    t = _training(spark, sf)
    return tidy(ML.anomaly_evaluation(_forest(t).predict(t.filter("not is_train"))))
