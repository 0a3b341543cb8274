"""Quality as an ordinal regression on graded ratings (cumulative logits).

A document has one score ``f = w . x``, shared by all grades, and grades have ordered thresholds
``t_1 < t_2 < ...``: ``P(grade >= k) = sigmoid(f - t_k)``. That gives the expected grade (their sum) and the
tail probability of the best grade, by which documents are selected.

Features are hashed: each distinct word of the whole text, and the quantised shape of the text (size, share of
repeated words, of marks, of its most frequent word, length of words). They are present or not, and divided by a
root of their number, so long texts are not judged by their length.

Fitting: on at most ``SAMPLE`` labelled documents (those with the smallest hash of their id), in one task, by
stochastic gradients with a rate of its own for each weight. Scoring: every document, without a shuffle; the model is
``2**BITS`` numbers however large the corpus.

* null or empty text: only its shape is known; null id: scored like others, never trained on;
* a document with several ratings takes the worst; ratings without a document, or null, are left out;
* equal texts have equal scores; texts are read whole; no labels at all: every tail probability is 1;
* extra columns of the labels are not looked at; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx

BITS = 20
LEAST = 4  # documents of the sample that a feature must be in
SAMPLE = 20_000
EPOCHS = 10
RATE = 1.0
SHRINK = 1e-6
ROOT = 0.5
KEEP = 0.5
SEED = 7

RESULT = "doc_id long, score double, expected_grade double, tail_probability double, keep boolean"


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[:, None] - score[None, :], -60, 60)))


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, 1 poor, 2 good; the worst of several ratings."""
    grade: Column = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(
        F.min("grade").alias("grade"))


def hashed(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first text, end, text of each feature, feature)`` for slices of a text column, each feature once a text."""
    mask = tx.U64((1 << bits) - 1)
    for i, j, w in tx.batches_of_words(column):
        n = j - i
        count = np.diff(w.bounds)
        doc = np.repeat(np.arange(n), count)
        order = np.lexsort((w.hashes, doc))
        h, d = w.hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        runs = np.diff(first, append=len(h))
        distinct = np.bincount(d[first], minlength=n)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, d[first], runs)
        letters = np.zeros(len(w.data) + 1, np.int64)
        mark = np.zeros(256, bool)
        mark[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True
        np.cumsum(mark[w.data], out=letters[1:])
        size = w.ends - w.starts
        marks = np.bincount(doc, (letters[w.ends] - letters[w.starts]) / np.maximum(size, 1), n)
        some = np.maximum(count, 1)
        shape = np.stack([np.minimum(np.log2(count + 1).astype(int), 15), (10 * distinct / some).astype(int),
                          np.minimum((20 * marks / some).astype(int), 15), np.minimum((10 * top / some).astype(int), 9),
                          np.minimum((np.bincount(doc, size, n) / some).astype(int), 15)])
        kinds = np.repeat(np.arange(1, len(shape) + 1), n) << 32
        extra = tx.mix((kinds + shape.ravel()).astype(tx.U64))
        texts = np.concatenate([d[first], np.tile(np.arange(n), len(shape))])
        features = (np.concatenate([h[first], extra]) & mask).astype(np.int64)
        key = np.unique(texts << bits | features)
        yield i, j, key >> bits, key & ((1 << bits) - 1)


def scaled(texts: np.ndarray, n: int) -> np.ndarray:
    """The value of each present feature."""
    return (1 / np.maximum(np.bincount(texts, minlength=n), 1) ** ROOT)[texts]


def train(features: list[np.ndarray], grade: np.ndarray, bits: int = BITS) -> Model:
    """Features of each document and its grade, from 0."""
    top = int(grade.max()) if len(grade) else 0
    weights, thresholds = np.zeros(1 << bits), np.arange(top, dtype=float) - (top - 1) / 2
    if not top:
        return Model(weights, np.zeros(0))
    scale = 1 / np.maximum(np.array([len(f) for f in features]), 1) ** ROOT
    seen = np.bincount(np.concatenate(features), minlength=1 << bits) >= LEAST
    features = [f[seen[f]] for f in features]  # what only some documents have would tell them by heart
    square, t_square = np.full(1 << bits, 1e-4), np.full(top, 1.0)
    share = np.bincount(grade, minlength=top + 1) / len(grade)
    balance = (1 / np.maximum(share, 1e-3)) ** 0.5
    balance /= (balance * share).sum()
    rng = np.random.default_rng(SEED)
    levels = np.arange(1, top + 1)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(grade)), max(1, len(grade) // 32)):
            at = np.concatenate([features[k] for k in some])
            row = np.repeat(np.arange(len(some)), [len(features[k]) for k in some])
            x = scale[some][row]
            f = np.bincount(row, weights[at] * x, len(some))
            y = grade[some]
            # P(y) = s(f - t_y) - s(f - t_{y+1}); its log has slope 1 - s(upper) - s(lower) in f
            upper = np.where(y > 0, 1 / (1 + np.exp(-(f - thresholds[np.maximum(y - 1, 0)]))), 1.0)
            lower = np.where(y < top, 1 / (1 + np.exp(-(f - thresholds[np.minimum(y, top - 1)]))), 0.0)
            slope = (1 - upper - lower) * balance[y]
            p = np.maximum(upper - lower, 1e-9)
            where, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, slope[row] * x, len(where)) / len(some) - SHRINK * weights[where]
            square[where] += g * g
            weights[where] += RATE * g / np.sqrt(square[where])
            t = np.zeros(top)
            np.add.at(t, np.maximum(y - 1, 0), np.where(y > 0, -upper * (1 - upper) / p * balance[y], 0))
            np.add.at(t, np.minimum(y, top - 1), np.where(y < top, lower * (1 - lower) / p * balance[y], 0))
            t /= len(some)
            t_square += t * t
            thresholds += RATE * t / np.sqrt(t_square)
            thresholds = np.maximum.accumulate(thresholds + 1e-3 * levels) - 1e-3 * levels  # they stay in order
    return Model(weights, thresholds)


def _features(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, j, text, feature in hashed(batch.column("text")):
            ends = np.searchsorted(text, np.arange(j - i + 1))
            out += [feature[ends[k]:ends[k + 1]].astype("<i4").tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(out, pa.binary())], ["grade", "features"])


def _train(batches) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    model = train([np.frombuffer(r["features"], "<i4") for r in rows], np.array([r["grade"] for r in rows], np.int64))
    at = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<i4"), model.weights[at].astype("<f4"), model.thresholds)],
        ["at", "weights", "thresholds"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled documents."""
    graded = grades(labels)
    some = graded.join(docs.select(F.col(id_col).alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    some = some.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")
    rows = texts.select("doc_id", F.col("grade").cast("long"), "text").mapInArrow(_features, "grade long, features binary")
    trained = (rows.repartition(1).sortWithinPartitions("grade", "features")
               .mapInArrow(_train, "at binary, weights binary, thresholds binary").collect())
    weights = np.zeros(1 << BITS, np.float32)
    for r in trained:
        weights[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["weights"], "<f4")
    return Model(weights, np.frombuffer(trained[0]["thresholds"]) if trained else np.zeros(0))


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, expected grade and tail probability of the best grade of each text."""
    total = np.zeros(len(column))
    for i, j, text, feature in hashed(column):
        total[i:j] = np.bincount(text, model.weights[feature].astype(float) * scaled(text, j - i), j - i)
    tails = model.tails(total)
    return total, tails.sum(axis=0), tails[-1] if len(tails) else np.ones(len(total))


def _score(model: Model, keep: float) -> Callable:
    def run(batches):
        for batch in batches:
            score, expected, tail = scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (score, expected, tail, tail >= keep))],
                                             [f.split()[0] for f in RESULT.split(", ")])
    return run


def rate(docs: DataFrame, model: Model, *, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score, expected grade, tail probability and verdict of every document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(model, keep), RESULT)


def _select(model: Model, keep: float, at: int) -> Callable:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at))[2] >= keep))
    return run


def selected(docs: DataFrame, model: Model, *, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The documents that are kept, as they are."""
    return docs.mapInArrow(tx.tidy(_select(model, keep, docs.columns.index(text_col))), docs.schema)
