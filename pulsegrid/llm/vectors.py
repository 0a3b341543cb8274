"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Every vector is divided by its length and projected on many random directions. Two vectors collide in a
projection if their values are at most ``WINDOW`` apart, a window centred on either of them; the closer they are,
the more often. Pairs with enough collisions are verified by their cosine in double precision.

* *Windows instead of pairs.* A table combines ``levels`` projections, each cut into cells of ``WIDTH`` deviations from a random
  offset; a vector is in one cell of each table. There one more projection is sorted and its windows are read off. The number of
  levels grows with the logarithm of the number of vectors, so cells keep their size. A cell keeps 0.86 of the
  pairs at the threshold and 0.57 of all others: the number of tables, and of copies of a vector, grows as n^0.27.
* *Calibration.* A pair at the threshold collides in a projection with probability ``p`` (a normal distribution). The
  number of tables, by the chance of ``p`` and of equal cells, and the least number of collisions are chosen such that it passes each of these with a
  probability of ``RECALL``; closer pairs pass more often.
* *Each pair once.* It counts in the first table where it collides. So links are
  summed without a list of pairs: a cell returns a number per vector and the edges of a spanning forest.
* *Copies and crowds.* Identical vectors are one with a multiplicity. A cell of more than ``BLOCK`` vectors is
  joined in pairs of blocks, so a crowd of near copies is many bounded tasks.

* null, empty or zero vectors, and those with null or non-finite components: linked with nothing;
* vectors of different dimensions are never linked; null ids: linked with nothing, component null;
* rows that share an id are one vertex; ties: the smallest id is the component; labels and extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.components import components
from pulsegrid.llm.store import stored
from pulsegrid.llm.text import mix

THRESHOLD = 0.9
WINDOW = 0.75  # in standard deviations of a projection
RECALL = 0.995
WIDTH = 2.5  # of a cell, in standard deviations
CELL = 4096  # vectors in a cell, about
GROUP = 20_000  # rows that are handled together, about
BLOCK = 16_384
PROJECTIONS = 16
SCALE = 2048  # projections are kept as 16-bit numbers
LIMIT = 16_000  # far beyond any window; differences still fit
ROWS, COLUMNS = 128, 4096  # of a block of pairs, small enough for a processor's cache
SEED = 20240229

VECTORS = "vec_id long, digest binary, dim int, vector binary, marks binary, cells array<int>"
FOUND = "vec_id long, links long, a long, b long"


@dataclass(frozen=True)
class Plan:
    threshold: float
    levels: int
    tables: int
    projections: int  # that are counted; those of the first ``tables`` are sorted, one in each
    collisions: int

    @property
    def window(self) -> int:
        return int(WINDOW * SCALE)


def _together(apart: float) -> float:
    """Probability that two values whose difference has deviation ``apart`` are in one cell of a random offset."""
    x = WIDTH / apart
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    apart = math.sqrt(2 - 2 * threshold)  # distance of unit vectors, and deviation of their projections' difference
    p = math.erf(WINDOW / apart / math.sqrt(2))
    levels = max(1, math.ceil(math.log(max(n, 1) / CELL) / -math.log(_together(math.sqrt(2)))))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p * _together(apart) ** levels)))
    m = max(PROJECTIONS, tables)
    tail, least = 0.0, m + 1
    while tail < recall:
        least -= 1
        tail += math.comb(m, least) * p ** least * (1 - p) ** (m - least)
    return Plan(threshold, levels, tables, m, least)


def directions(dim: int, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Directions that are counted, then those of the cells, table by table; and the offsets of the cells."""
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, p.projections + p.tables * p.levels)), rng.random(p.tables * p.levels) * WIDTH


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows ** 2).sum(axis=1, keepdims=True))


def coded_vectors(unit: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Marks (16 bits for each counted projection) and cells (a number for each table) of unit vectors."""
    drawn, offsets = directions(unit.shape[1], p)
    values = unit @ drawn
    marks = np.clip(np.rint(values[:, :p.projections] * SCALE), -LIMIT, LIMIT).astype("<i2")
    places = np.floor((values[:, p.projections:] + offsets) / WIDTH).astype(np.int64).reshape(len(unit), p.tables, p.levels)
    cells = np.zeros(places.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for level in range(p.levels):
            cells = mix(cells * np.uint64(0x9E3779B97F4A7C15) + places[:, :, level].view(np.uint64))
    return marks, (cells >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _code(p: Plan, single: bool) -> Callable:
    kind = "<f4" if single else "<f8"

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            rows = []
            for i, v in enumerate(column):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else np.zeros(0)
                x = np.asarray(x, kind) + 0.0  # one zero
                rows.append(x if ids[i].is_valid and np.isfinite(x).all() and x.any() else None)
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                if r is not None:
                    by_dim.setdefault(len(r), []).append(i)
            marks, cells = [None] * len(rows), [None] * len(rows)
            for some in by_dim.values():
                m, c = coded_vectors(unit_vectors(np.stack([rows[i] for i in some])), p)
                for k, i in enumerate(some):
                    marks[i], cells[i] = m[k].tobytes(), c[k]
            raw = [None if r is None else r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in raw], pa.binary()),
                 pa.array([0 if r is None else len(r) for r in rows], pa.int32()), pa.array(raw, pa.binary()),
                 pa.array(marks, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "digest", "dim", "vector", "marks", "cells"])
    return run


def _pairs(p: Plan, t: int, marks_a, marks_b, cells_a, cells_b, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one cell of table ``t`` that collide in its window, in none of an earlier table, and often enough."""
    twice = np.uint16(2 * p.window)
    order_a, order_b = np.argsort(marks_a[:, t], kind="stable"), np.argsort(marks_b[:, t], kind="stable")
    sorted_a, sorted_b = np.ascontiguousarray(marks_a[order_a].T), np.ascontiguousarray(marks_b[order_b].T)
    hits = np.empty((ROWS, COLUMNS), np.uint8 if p.projections < 256 else np.uint16)
    apart = np.empty((ROWS, COLUMNS), np.int16)
    for k in range(0, len(order_a), ROWS):
        own = sorted_a[:, k:k + ROWS]
        low, high = np.searchsorted(sorted_b[t], [int(own[t, 0]) - p.window, int(own[t, -1]) + p.window + 1])
        if same:
            low = max(low, k + 1)  # pairs are taken in the order of the table's projection
        for begin in range(low, high, COLUMNS):
            other = sorted_b[:, begin:min(begin + COLUMNS, high)]
            shape = slice(own.shape[1]), slice(other.shape[1])
            count, difference = hits[shape], apart.reshape(-1)[:own.shape[1] * other.shape[1]].reshape(own.shape[1], -1)
            count[:] = 0
            for c in range(p.projections):
                np.subtract(own[c, :, None] + np.int16(p.window), other[c], out=difference)
                count += difference.view(np.uint16) <= twice
            i, j = np.nonzero(count >= p.collisions)
            if same:
                later = begin + j > k + i
                i, j = i[later], j[later]
            near = np.abs(own[:p.tables, i].astype(np.int32) - other[:p.tables, j]) <= p.window
            i, j = order_a[k + i], order_b[begin + j]
            right = near[t]
            for earlier in range(t):  # counted there
                right &= ~(near[earlier] & (cells_a[i, earlier] == cells_b[j, earlier]))
            yield i[right], j[right]


def _join(p: Plan, single: bool) -> Callable:
    kind = "<f4" if single else "<f8"

    def one(t: int, same: bool, first: np.ndarray, ids, mult, marks, cells, unit) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Links of each vector, and the edges of a spanning forest, in one cell or pair of blocks of a cell."""
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        edges: list[tuple[int, int]] = []
        a, b = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        for i, j in _pairs(p, t, marks[a], marks[b], cells[a], cells[b], same) if len(a) and len(b) else ():
            i, j = a[i], b[j]
            for s in range(0, len(i), 65536):
                x, y = i[s:s + 65536], j[s:s + 65536]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= p.threshold
                x, y = x[near], y[near]
                links += np.bincount(x, mult[y], len(ids)).astype(np.int64) + np.bincount(y, mult[x], len(ids)).astype(np.int64)
                while True:  # join roots until all found pairs are in one tree each
                    while (root[root] != root).any():
                        root = root[root]
                    u, v = root[x], root[y]
                    apart = u != v
                    if not apart.any():
                        break
                    top, at = np.unique(np.maximum(u, v)[apart], return_index=True)
                    root[top] = np.minimum(u, v)[apart][at]
                    edges += zip(ids[x[apart][at]].tolist(), ids[y[apart][at]].tolist(), strict=True)
        return links, edges

    def run(_, table):
        part, cell, dim, low, high, block, ids, mult = (table.column(c).to_numpy() for c in ("part", "cell", "dim", "low", "high", "block", "vec_id", "n"))
        marks, vectors, cells = (table.column(c).to_pylist() for c in ("marks", "vector", "cells"))
        order = np.lexsort((high, low, dim, cell, part))
        keys = np.stack([part, cell, dim, low, high])[:, order]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        out: list[list] = [[], [], [], []]
        for at in np.split(order, cuts):
            if len(at) < 2:
                continue
            k = at[0]
            links, edges = one(int(part[k]), low[k] == high[k], block[at] == low[k], ids[at], mult[at],
                               np.stack([np.frombuffer(marks[i], "<i2") for i in at]), np.array([cells[i] for i in at], np.int32),
                               unit_vectors(np.stack([np.frombuffer(vectors[i], kind) for i in at])))
            some = np.flatnonzero(links)
            out[0] += ids[at][some].tolist() + [None] * len(edges)
            out[1] += links[some].tolist() + [None] * len(edges)
            out[2] += [None] * len(some) + [x for x, _ in edges]
            out[3] += [None] * len(some) + [y for _, y in edges]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("vec_id", "links", "a", "b"), out, strict=True)})
    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>"))
    p = plan(rows.count(), threshold)
    coded = stored(rows.mapInArrow(_code(p, single), VECTORS), "vectors")
    thin = coded.select("vec_id", "digest", "dim")
    classes = stored(thin.where("digest IS NOT NULL").groupBy("digest", "dim").agg(
        F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("n")), "classes")
    own = coded.join(classes.select("digest", "n", F.col("rep").alias("vec_id")), ["digest", "vec_id"]).dropDuplicates(["vec_id", "digest"])
    visits = own.select("vec_id", "n", "dim", "vector", "marks", "cells", F.posexplode("cells").alias("part", "cell"))
    visits = stored(visits, "visits")
    crowded = (visits.groupBy("part", "cell", "dim").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
               .withColumn("blocks", F.ceil(F.col("size") / BLOCK)).drop("size"))
    dealt = (visits.join(crowded, ["part", "cell", "dim"], "left").fillna(1, ["blocks"])
             .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks"))
    groups = -(-classes.count() * p.tables // GROUP) + 1  # small cells are handled together
    group = F.pmod(F.xxhash64("part", "cell", "dim", "low", "high"), F.lit(groups)).alias("group")
    found = stored(dealt.select("*", group).groupBy("group").applyInArrow(_join(p, single), FOUND), "found")
    links = found.where("links IS NOT NULL").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(found.where("a IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), F.col("component"))
    named = thin.join(classes.select("digest", "dim", "rep", "n"), ["digest", "dim"], "left").join(links, "rep", "left").join(labels, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return named.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"),
                        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
