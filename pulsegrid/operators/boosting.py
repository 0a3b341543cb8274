"""Gradient-boosted trees for squared error and pinball (quantile) loss, several objectives in the same jobs.

1. *Bins.* Features are cut at approximate quantiles into at most ``BINS`` bins. Rows are kept in blocks of one byte per feature,
   the label, and the current prediction of every objective.
2. *Levels.* One job grows a level of a tree for all objectives: each partition sums the gradients of its rows per node, feature
   and bin, the sums of a node meet in one group, and the best split comes back. A group holds one histogram per
   partition, of fixed size, however many rows there are.
3. *Leaves.* For squared error a leaf has the mean gradient, known from the splits. For pinball loss of quantile ``q`` the
   structure follows the gradient (``q`` above, ``q - 1`` below the prediction), and the leaf takes the ``q``-quantile of its rows'
   residuals, a mergeable sketch.
4. *State.* After ``FOLD`` trees the blocks are written with their new predictions and the older ones are dropped; until then
   the few new trees are applied on the way. A lost executor costs at most the recomputation of these.

The driver holds the trees (at most 2^depth nodes each) and the cuts. Rows with a missing label don't train; a missing feature is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import drop_folder, scratch

BINS = 64
FOLD = 5
TASK = 16  # blocks (of an Arrow batch's rows) that a task handles, at least
LEAST_ROWS = 20  # of a leaf
STATE = "block long, bins binary, label binary, prediction binary"
SUMS = "objective int, node int, sums binary"
SPLITS = "objective int, node int, feature int, cut int, n_left double, g_left double, n_right double, g_right double"


@dataclass
class Tree:
    """A heap of nodes: the children of ``k`` are ``2k`` and ``2k + 1``, the root is 1; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size))

    def leaves(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row (a column of ``bins``) reaches in so many levels."""
        at, rows = np.ones(bins.shape[1], np.int32), np.arange(bins.shape[1])
        for _ in range(levels):
            split = self.feature[at]
            inner = split >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + (bins[split, rows] > self.cut[at]), at)
        return at


@dataclass
class BoostedTrees:
    """For each objective a start value and trees, over common cuts of the features."""

    objectives: dict[str, float | None]  # name -> quantile, or None for the mean
    features: list[str]
    cuts: list[np.ndarray]
    start: list[float]
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left").astype(np.uint8) for k, c in enumerate(self.cuts)])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds a column for each objective."""
        names = list(self.objectives)
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for features in batches:
                out = np.tile(np.array(model.start)[:, None], len(features))
                if len(features):
                    advance(out, model.bins(np.stack(features.to_numpy())), model.rounds, model.depth)
                yield pd.DataFrame(dict(zip(names, out, strict=True)))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        udf = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))
        return df.withColumn("_all", udf(vector(self.features))).select(*df.columns, "_all.*")

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = [(t, o, *(a.tolist() for a in (tree.feature, tree.cut, tree.value))) for t, trees in enumerate(self.rounds) for o, tree in enumerate(trees)]
        spark.createDataFrame(nodes, "round int, objective int, feature array<int>, cut array<int>, value array<double>").write.mode("overwrite").parquet(f"{path}/trees")
        meta = [(list(self.objectives), list(self.objectives.values()), self.features, [c.tolist() for c in self.cuts], self.start, self.depth)]
        spark.createDataFrame(meta, "objectives array<string>, quantiles array<double>, features array<string>, cuts array<array<double>>, "
                              "start array<double>, depth int").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        m = spark.read.parquet(f"{path}/meta").first()
        model = cls(dict(zip(m["objectives"], m["quantiles"], strict=True)), list(m["features"]), [np.array(c, float) for c in m["cuts"]],
                    list(m["start"]), m["depth"])
        rows = spark.read.parquet(f"{path}/trees").orderBy("round", "objective").collect()  # rounds x objectives
        for r in rows:
            if r["objective"] == 0:
                model.rounds.append([])
            model.rounds[-1].append(Tree(np.array(r["feature"], np.int16), np.array(r["cut"], np.int16), np.array(r["value"])))
        return model


def vector(features: Sequence[str]) -> Column:
    """The features of a row; what is missing counts as 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])


def advance(predictions: np.ndarray, bins: np.ndarray, rounds: Sequence[Sequence[Tree]], depth: int) -> None:
    for trees in rounds:
        for o, tree in enumerate(trees):
            predictions[o] += tree.value[tree.leaves(bins, depth)]


def _blocks(model: BoostedTrees) -> Callable:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                start = np.tile(np.array(model.start)[:, None], batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block")[:1], *(pa.array([b], pa.binary()) for b in (
                        model.bins(x).tobytes(), batch.column("y").to_numpy().tobytes(), start.tobytes()))],
                    ["block", "bins", "label", "prediction"])
    return run


def _rows(batch: pa.RecordBatch, objectives: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``block, bins, labels, predictions`` of each block."""
    for block, bins, label, prediction in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        y = np.frombuffer(label)
        yield block, np.frombuffer(bins, np.uint8).reshape(-1, len(y)), y, np.frombuffer(prediction).reshape(objectives, -1).copy()


def _fold(rounds: list, objectives: int, depth: int) -> Callable:
    def run(batches):
        for batch in batches:
            out = []
            for _, bins, _, prediction in _rows(batch, objectives):
                advance(prediction, bins, rounds, depth)
                out.append(prediction.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], batch.schema.names)
    return run


def _drawn(seed: int, number: int, block: int, n: int, share: float) -> np.ndarray:
    """The rows of a block that a tree learns from."""
    return np.random.default_rng([seed, number, block]).random(n) < share


def _gradient(residual: np.ndarray, quantile: float | None) -> np.ndarray:
    return residual if quantile is None else np.where(residual > 0, quantile, quantile - 1)


def _sums(quantiles: list, rounds: list, trees: list[Tree], level: int, depth: int, draw: tuple) -> Callable:
    """Number of rows and sum of gradients per objective, node of the level, feature and bin, over a partition."""
    def run(batches):
        first, total = 1 << level, {}
        for batch in batches:
            for block, bins, y, prediction in _rows(batch, len(quantiles)):
                advance(prediction, bins, rounds, depth)
                drawn = _drawn(draw[0], draw[1], block, len(y), draw[2])
                for o, q in enumerate(quantiles):
                    node = trees[o].leaves(bins, level)
                    some = np.flatnonzero(drawn & (node >= first))
                    if not len(some):
                        continue
                    g, base = _gradient(y[some] - prediction[o, some], q), (node[some] - first) * BINS
                    sums = total.setdefault(o, np.zeros((2, first, len(bins), BINS)))
                    for f in range(len(bins)):
                        key = base + bins[f, some]
                        sums[0, :, f] += np.bincount(key, minlength=first * BINS).reshape(first, BINS)
                        sums[1, :, f] += np.bincount(key, g, first * BINS).reshape(first, BINS)
        found = [(o, k, s[:, k].tobytes()) for o, s in total.items() for k in np.flatnonzero(s[0, :, 0].sum(axis=1)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([first + r[1] for r in found], pa.int32()),
                                          pa.array([r[2] for r in found], pa.binary())], ["objective", "node", "sums"])
    return run


def best_split(n: np.ndarray, g: np.ndarray, least: int) -> tuple | None:
    """``feature, cut, n_left, g_left, n_right, g_right`` of the largest gain of (features, bins) sums, or None."""
    n_left, g_left = np.cumsum(n, axis=1)[:, :-1], np.cumsum(g, axis=1)[:, :-1]
    n_right, g_right = n[0].sum() - n_left, g[0].sum() - g_left
    allowed = (n_left >= least) & (n_right >= least)
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, g_left ** 2 / n_left + g_right ** 2 / n_right, -np.inf)
    f, cut = np.unravel_index(np.argmax(gain), gain.shape)
    whole = g[0].sum() ** 2 / n[0].sum()
    if gain[f, cut] <= whole + 1e-12 * max(whole, 1e-300):
        return None
    return int(f), int(cut), n_left[f, cut], g_left[f, cut], n_right[f, cut], g_right[f, cut]


def _split(features: int, least: int) -> Callable:
    def run(key, table):
        n, g = sum(np.frombuffer(b).reshape(2, features, BINS) for b in table.column("sums").to_pylist())
        found = best_split(n, g, least)
        rows = [] if found is None else [(key[0].as_py(), key[1].as_py(), *found)]
        names = [c.split()[0] for c in SPLITS.split(", ")]
        types = [pa.int32()] * 4 + [pa.float64()] * 4
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, types, strict=True))})
    return run


def _residuals(quantiles: list, rounds: list, trees: list[Tree], depth: int, draw: tuple) -> Callable:
    def run(batches):
        for batch in batches:
            for block, bins, y, prediction in _rows(batch, len(quantiles)):
                advance(prediction, bins, rounds, depth)
                some = np.flatnonzero(_drawn(draw[0], draw[1], block, len(y), draw[2]))
                for o, q in enumerate(quantiles):
                    if q is not None:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), o), pa.int32()), pa.array(trees[o].leaves(bins[:, some], depth), pa.int32()),
                             pa.array(y[some] - prediction[o, some])], ["objective", "node", "residual"])
    return run


class _State:
    """The blocks in their newest written form; kept in memory where there is room, read again where not.

    Tasks get at least ``TASK`` blocks, as a level of few rows costs less than the start of another task.
    """

    def __init__(self, blocks: DataFrame):
        self.spark, self.path, self.df = blocks.sparkSession, None, None
        self.write(blocks)
        self.tasks = max(1, self.df.count() // TASK)
        self.write(self.df)

    def write(self, blocks: DataFrame) -> None:
        path = scratch(self.spark, "boosting")
        blocks.write.parquet(path)
        old, before = self.path, self.df
        self.path, self.df = path, self.spark.read.schema(STATE).parquet(path)
        if hasattr(self, "tasks"):
            self.df = self.df.coalesce(self.tasks)
        self.df = self.df.persist()
        if before is not None:
            before.unpersist()
            drop_folder(self.spark, old)


def fit(train: DataFrame, label: str, features: Sequence[str], objectives: Mapping[str, float | None], *, trees: int = 200, depth: int = 8,
        rate: float = 0.1, share: float = 0.8, seed: int = 42, least: int = LEAST_ROWS) -> BoostedTrees:
    """Boosted trees for ``{name: quantile}`` (None: the mean); each tree learns from a ``share`` of the rows."""
    rows = train.select(vector(features).alias("x"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL AND NOT isnan(y)")
    names, quantiles, features = list(objectives), list(objectives.values()), list(features)
    probes = F.lit([k / BINS for k in range(1, BINS)])
    asked = [F.percentile_approx(F.get("x", F.lit(k)), probes).alias(f"_{k}") for k in range(len(features))]
    starts = [F.avg("y") if q is None else F.percentile_approx("y", q) for q in quantiles]
    stats = rows.agg(*asked, *[s.alias(f"start_{o}") for o, s in enumerate(starts)]).first()  # some numbers for each feature
    model = BoostedTrees(dict(objectives), features, [np.unique(stats[f"_{k}"] or []).astype(float) for k in range(len(features))],
                         [float(stats[f"start_{o}"] or 0) for o in range(len(names))], depth)
    state = _State(rows.withColumn("block", F.monotonically_increasing_id()).mapInArrow(_blocks(model), STATE))
    fresh: list[list[Tree]] = []
    for number in range(trees):
        grown, draw = [Tree.empty(depth) for _ in names], (seed, number, share)
        for level in range(depth):
            sums = state.df.mapInArrow(_sums(quantiles, fresh, grown, level, depth, draw), SUMS)
            splits = sums.groupBy("objective", "node").applyInArrow(_split(len(features), least), SPLITS).collect()  # a row per node
            for s in splits:
                tree, k = grown[s["objective"]], s["node"]
                tree.feature[k], tree.cut[k] = s["feature"], s["cut"]
                tree.value[2 * k], tree.value[2 * k + 1] = rate * s["g_left"] / s["n_left"], rate * s["g_right"] / s["n_right"]
            if not splits:
                break
        if any(q is not None for q in quantiles):
            residuals = state.df.mapInArrow(_residuals(quantiles, fresh, grown, depth, draw), "objective int, node int, residual double")
            asked = F.percentile_approx("residual", F.lit([q or 0.5 for q in quantiles])).alias("at")
            for r in residuals.groupBy("objective", "node").agg(asked).collect():  # a row per leaf
                grown[r["objective"]].value[r["node"]] = rate * r["at"][r["objective"]]
        fresh.append(grown)
        model.rounds.append(grown)
        if len(fresh) == FOLD and number + 1 < trees:
            state.write(state.df.mapInArrow(_fold(fresh, len(names), depth), STATE))
            fresh = []
    state.df.unpersist()
    drop_folder(state.spark, state.path)
    return model
