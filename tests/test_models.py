"""Forecaster bounds and anomaly model on a small series."""

import numpy as np
import pandas as pd

from pulsegrid.operators import models as ML


def test_isolation_forest_finds_the_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    x[:6] += 9
    pdf = pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(pdf)
    forest = ML.fit_isolation_forest(df, "id", features=["a", "b"], trees=30, sample=128, contamination=0.01)
    got = forest.predict(df).toPandas()
    assert set(got.nsmallest(6, "anomaly_score")["id"]) == set(range(6))
    assert got["anomaly_score"].between(-1, 0).all() and got["is_anomaly"].sum() == 6
    again = ML.fit_isolation_forest(df.repartition(7), "id", features=["a", "b"], trees=30, sample=128, contamination=0.01)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True))


def test_forecaster_bounds(spark):
    rng = np.random.default_rng(3)
    n = 600
    a = rng.uniform(0, 100, n)
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=n, freq="min"), "a": a, "b": rng.normal(size=n),
                        "future_req_rate_5m": 3 * a + rng.normal(0, 5, n)})
    df = spark.createDataFrame(pdf)
    model = ML.fit_forecaster(df, features=["a", "b"], trees=30, depth=4)
    out = model.predict(df)
    rows = out.toPandas()
    assert (rows["lower"] <= rows["main"]).all() and (rows["main"] <= rows["upper"]).all()
    inside = rows["future_req_rate_5m"].between(rows["lower"], rows["upper"]).mean()
    assert 0.5 < inside < 0.99
    assert ML.forecast_error(out).first()["mae"] < 20
