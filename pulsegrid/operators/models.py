"""Training sets, load forecaster (boosted trees) and anomaly model (bounded per-tree samples)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import boosting
from pulsegrid.operators.ordered import time_index
from pulsegrid.operators.quantiles import exact_median, exact_percentiles
from pulsegrid.schema import FEATURE_COLS
from pulsegrid.session import materialise

# Hyper-parameters of the forecaster and the anomaly model.
FORECAST_PARAMS = {"trees": 200, "depth": 8, "rate": 0.1, "share": 0.8, "seed": 42}
QUANTILES = {"main": None, "q10": 0.1, "q90": 0.9}
TREES, SAMPLE, CONTAMINATION = 100, 256, 0.05
TRAIN_SHARE = 0.8
EULER_GAMMA = 0.5772156649015329


def chronological_split(df: DataFrame, share: float = TRAIN_SHARE, ts: str = "timestamp") -> DataFrame:
    """Adds ``is_train``: the first ``int(share * n)`` rows in time order."""
    indexed = df if "idx" in df.columns else time_index(df, ts)
    n = indexed.agg(F.count(F.lit(1)).alias("_rows"))
    cut = F.floor(F.col("_rows") * F.lit(share))
    return indexed.crossJoin(F.broadcast(n)).withColumn("is_train", F.col("idx") < cut).drop("_rows")


def normal_traffic(train: DataFrame, rate: str = "req_rate_1m", surge: str = "is_surge") -> DataFrame:
    """Rows at most three times the median rate and not marked as surge."""
    median = exact_median(train, rate, out="_median")
    keep = F.col(rate) <= F.lit(3.0) * F.col("_median")
    if surge in train.columns:
        keep = keep & (F.col(surge) == 0)
    return train.crossJoin(F.broadcast(median)).filter(keep).drop("_median")


# -- forecaster ----------------------------------------------------------------------------------

@dataclass
class Forecaster:
    """Trees for the mean and for the 10 % and 90 % quantiles, and what the bounds are widened by."""

    trees: boosting.BoostedTrees
    widening: float

    def save(self, path: str) -> None:
        """The trees and the widening, below ``path``."""
        spark = SparkSession.active()
        self.trees.save(spark, path)
        spark.createDataFrame([(self.widening,)], "widening double").write.mode("overwrite").parquet(f"{path}/widening")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        return cls(boosting.BoostedTrees.load(spark, path), spark.read.parquet(f"{path}/widening").first()[0])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``main``, ``lower`` and ``upper``; the bounds enclose the prediction."""
        return self.trees.predict(df).withColumns({
            "lower": F.least(F.col("q10") - self.widening, "main"), "upper": F.greatest(F.col("q90") + self.widening, "main"),
        }).drop("q10", "q90")


def fit_forecaster(train: DataFrame, *, label: str = "future_req_rate_5m", features: Sequence[str] = FEATURE_COLS, ts: str = "timestamp",
                   **params) -> Forecaster:
    """Boosted trees on the first 80 % of the training rows. The rest tells how far the quantiles must be moved
    outwards (or inwards) for 80 % of its labels to lie between them."""
    parts = chronological_split(train.drop("is_train"), ts=ts)
    fit_rows, held_out = (parts.filter(c).select(*features, label) for c in ("is_train", "not is_train"))
    trees = boosting.fit(fit_rows, label, features, QUANTILES, **{**FORECAST_PARAMS, **params})
    outside = F.greatest(F.col("q10") - F.col(label), F.col(label) - F.col("q90"))
    excess = materialise(trees.predict(held_out.filter(F.col(label).isNotNull())).select(outside.alias("excess")))
    found = exact_percentiles(excess, "excess", {"widening": 0.8}).first()
    return Forecaster(trees, found["widening"] if found else 0.0)


def coverage(predicted: DataFrame, label: str = "future_req_rate_5m") -> DataFrame:
    """Share of the labels that lie within the bounds."""
    inside = F.col(label).between(F.col("lower"), F.col("upper"))
    return predicted.agg(F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("rows"))


def forecast_error(predicted: DataFrame, label: str = "future_req_rate_5m") -> DataFrame:
    err = F.col("main") - F.col(label)
    return predicted.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                         F.count(F.lit(1)).alias("rows"))


# -- isolation forest ----------------------------------------------------------------------------

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """Random splits until a value stands alone or the depth limit is reached. Returns nodes
    ``(node, feature, threshold, left, right, path)``; leaves have feature -1."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    count = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0, initial=np.inf), part.max(axis=0, initial=-np.inf)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        if not low[f] <= cut < high[f]:  # neighbouring doubles
            cut = float(low[f])
        goes_left = part[:, f] <= cut
        left, right = count, count + 1
        count += 2
        nodes.append((node, f, cut, left, right, 0.0))
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


@dataclass
class IsolationForest:
    """Nodes of all trees (bounded by trees x sample size) and the score below which a row counts
    as anomalous."""

    nodes: pd.DataFrame
    sample: int
    offset: float | None
    features: Sequence[str]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(self.sample, self.offset, list(self.features))]
        spark.createDataFrame(meta, "sample int, offset double, features array<string>").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/nodes").toPandas(), meta["sample"], meta["offset"], list(meta["features"]))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``anomaly_score`` in [-1, 0]; lower is more anomalous."""
        trees = []
        for _, t in self.nodes.groupby("tree"):
            t = t.sort_values("node")
            trees.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")))
        shared = df.sparkSession.sparkContext.broadcast((trees, average_path(self.sample)))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forest, norm = shared.value
            for features in batches:
                x = np.stack(features.to_numpy()) if len(features) else np.empty((0, 1))
                depth = np.zeros(len(x))
                for feature, threshold, left, right, path in forest:
                    at = np.zeros(len(x), dtype=np.int64)
                    while True:
                        f = feature[at]
                        inner = f >= 0
                        if not inner.any():
                            break
                        v = x[np.arange(len(x)), np.maximum(f, 0)]
                        step = np.where(v <= threshold[at], left[at], right[at])
                        at = np.where(inner, step, at)
                    depth += path[at]
                yield pd.Series(-np.power(2.0, -(depth / len(forest)) / norm))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        udf = F.pandas_udf(run, "double")
        vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        return df.withColumn("anomaly_score", udf(vector))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("is_anomaly", F.col("anomaly_score") < F.lit(self.offset))


def fit_isolation_forest(train: DataFrame, key: str, *, features: Sequence[str] = FEATURE_COLS, trees: int = TREES,
                         sample: int = SAMPLE, contamination: float = CONTAMINATION, seed: int = 42) -> IsolationForest:
    """Each tree grows in its own task on ``sample`` rows. The pool of ``trees * sample`` rows is the
    smallest by a hash of ``key``, so the model does not depend on partitioning."""
    pool = (
        train.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
        .orderBy("_h", key).limit(trees * sample)
        .select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"), "_h", key)
        .withColumn("_pos", F.row_number().over(W.orderBy("_h", key)) - 1)
        .select("_pos", "x")
    ).cache()
    size = pool.count()
    sample = min(sample, size)
    draws = train.sparkSession.range(trees * sample).select(
        (F.col("id") / sample).cast("int").alias("tree"), (F.col("id") % size).cast("int").alias("_pos"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = grow_tree(np.stack(pdf.sort_values("_pos")["x"].to_numpy()), seed * 1_000_003 + int(key[0]))
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", int(key[0]))
        return out

    nodes = draws.join(pool, "_pos").groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    pool.unpersist()
    forest = IsolationForest(nodes, sample, None, list(features))
    scores = materialise(forest.score(train).select("anomaly_score"))  # scored once, read twice
    forest.offset = exact_percentiles(scores, "anomaly_score", {"q": contamination}).first()[0]
    return forest


def anomaly_evaluation(predicted: DataFrame) -> DataFrame:
    hits, n = F.count_if("is_anomaly"), F.count(F.lit(1))
    return predicted.agg(hits.alias("anomalies"), n.alias("rows"),
                         (F.try_divide(hits, n) * 100.0).alias("percent"))
