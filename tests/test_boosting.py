"""Boosted trees: splits against brute force, a round by hand, quantile coverage on rows not seen, saved models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import boosting
from pulsegrid.operators import models as ML


def test_best_split_against_all_splits():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(0, 4, (3, 6)).astype(float)
        n[1:] = rng.permuted(np.tile(n[0], (2, 1)), axis=1)
        g = rng.normal(size=(3, 6)) * (n > 0)
        g[1:] *= (g[0].sum() / g[1:].sum(axis=1))[:, None] if (g[1:].sum(axis=1) != 0).all() else 0
        least = int(rng.integers(1, 4))
        gains = {}
        for f in range(3):
            for cut in range(5):
                left, right = n[f, :cut + 1].sum(), n[f, cut + 1:].sum()
                if left >= least and right >= least:
                    gains[f, cut] = g[f, :cut + 1].sum() ** 2 / left + g[f, cut + 1:].sum() ** 2 / right
        got = boosting.best_split(n, g, least)
        if got is None:
            assert not gains or max(gains.values()) <= g[0].sum() ** 2 / n[0].sum() + 1e-9
        else:
            assert gains[got[:2]] == pytest.approx(max(gains.values()))


def plain_round(x, y, start, quantile, depth, rate, least):
    """One tree over exact values, grown by looking at every cut; returns the new predictions."""
    prediction = np.full(len(y), start)
    residual = y - prediction
    g = residual if quantile is None else np.where(residual > 0, quantile, quantile - 1)

    def grow(rows, level):
        best = None
        for f in range(x.shape[1]) if level < depth else ():
            for cut in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= cut
                if least <= left.sum() <= len(rows) - least:
                    gain = g[rows][left].sum() ** 2 / left.sum() + g[rows][~left].sum() ** 2 / (~left).sum()
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, left
        if best is None or best[0] <= g[rows].sum() ** 2 / len(rows) + 1e-9:
            if quantile is None:
                prediction[rows] += rate * residual[rows].mean()
            else:
                prediction[rows] += rate * np.sort(residual[rows])[max(int(np.ceil(quantile * len(rows))) - 1, 0)]
        else:
            grow(rows[best[1]], level + 1)
            grow(rows[~best[1]], level + 1)

    grow(np.arange(len(y)), 0)
    return prediction


@pytest.mark.parametrize("quantile", [None, 0.1, 0.9])
def test_a_round_by_hand(spark, quantile):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 12, 400), rng.integers(0, 9, 400)], axis=1).astype(float)  # fewer values than bins
    y = x[:, 0] * 3 - x[:, 1] ** 2 + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).repartition(3)
    model = boosting.fit(df, "y", ["a", "b"], {"p": quantile}, trees=1, depth=3, share=1.1, least=20)
    got = model.predict(df).toPandas()
    want = plain_round(got[["a", "b"]].to_numpy(), got["y"].to_numpy(), model.start[0], quantile, 3, 0.1, 20)
    assert np.allclose(got["p"], want)


def series(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 100, n), rng.uniform(0, 10, n)
    return pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=n, freq="min"), "a": a, "b": b, "c": rng.normal(size=n),
                         "future_req_rate_5m": 3 * a + 20 * np.sin(b) + rng.normal(size=n) * (1 + b * 3)})


def test_bounds_cover_what_they_say_on_rows_not_seen(spark):
    model = ML.fit_forecaster(spark.createDataFrame(series(20_000, 1)).repartition(4), features=["a", "b", "c"], trees=40, depth=5)
    unseen = spark.createDataFrame(series(10_000, 2))
    out = model.predict(unseen)
    assert abs(ML.coverage(out).first()["coverage"] - 0.8) < 0.03
    rows = out.toPandas()
    width = rows["upper"] - rows["lower"]
    assert width[rows["b"] > 8].mean() > 2 * width[rows["b"] < 2].mean()  # bounds follow the noise, not its average
    assert (rows["lower"] <= rows["main"]).all() and (rows["main"] <= rows["upper"]).all()
    assert ML.forecast_error(out).first()["mae"] < rows["future_req_rate_5m"].std() / 4


def test_saved_trees_predict_the_same(spark, tmp_path):
    df = spark.createDataFrame(series(2000, 3))
    model = ML.fit_forecaster(df, features=["a", "b", "c"], trees=7, depth=3)
    model.save(str(tmp_path / "model"))
    again = ML.Forecaster.load(spark, str(tmp_path / "model"))
    holes = df.withColumn("a", F.when(F.col("a") > 50, F.col("a"))).withColumn("b", F.lit(None).cast("double"))
    assert model.predict(holes).toPandas().equals(again.predict(holes).toPandas())


def test_no_rows_and_missing_labels(spark):
    df = spark.createDataFrame(series(300, 4)).withColumn("future_req_rate_5m", F.when(F.col("a") > 30, F.col("future_req_rate_5m")))
    assert ML.fit_forecaster(df, features=["a"], trees=2, depth=2).predict(df).count() == 300
    empty = boosting.fit(df.where("1 = 0"), "future_req_rate_5m", ["a"], {"p": None, "q": 0.5}, trees=2, depth=2)
    assert empty.predict(df).where("p <> 0 OR q <> 0").isEmpty()
