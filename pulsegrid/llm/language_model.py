"""Scoring texts with a weighted backoff automaton of smoothed bigrams.

Model. Unigrams are smoothed by adding one: ``p1(w) = (c(w)+1) / (N+V+1)``. Bigrams interpolate an absolute
discount ``D`` with them: ``p(w|v) = (max(c(v,w)-D, 0) + D*T(v)*p1(w)) / c(v)``, where ``T(v)`` counts the distinct
successors of ``v``, and ``D = n1/(n1+2*n2)`` comes from the numbers of bigrams seen once and twice. For every
context the probabilities of all words and of one unseen word add up to 1. Every text ends in a token of its own,
which is also the context its first word is read in.

Automaton. Each context seen in training is a state, and there is one for no context. A state has an arc for each
word that followed it, with weight ``(c(v,w)-D)/c(v)``, and a failure arc to the empty state with weight
``D*T(v)/c(v)``; a word's probability is what its arc and the failure path give together. A text is read from left
to right; the state carried along is the last word if that is a state, else the empty one.

Distribution. Neither the corpus nor the automaton passes through one place. Texts are coded once into shards
(some MB of text: distinct words and token numbers) that are written down. Each shard sends its distinct words and
bigrams, with training counts, to buckets by a hash of the context; there they are summed, and every shard
gets back the arcs and states that its texts can reach: its part of the automaton, over which its texts are read.
Contexts with more than a quarter of a bucket's mean share are dealt out further by the next word (there are
at most ``4 * buckets`` of those), so a very frequent word is no burden.

* null text: empty, one token (the end); empty tables give no rows; no training text: all counts are 0;
* a null id: trained on, never held out; repeated ids or rows: each is trained on and scored as it stands;
* texts of any length are read whole; extra columns are left out.

Words are known by 64-bit hashes (see :mod:`pulsegrid.llm.text`).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx
from pulsegrid.llm.store import stored

SHARD = 10_000_000  # bytes of text to a shard, about
ENTRIES = 1_500_000  # bigrams sent to a bucket, about
FOLDS, HELD_OUT = 7, 2
END = tx.U64(0x656E64)  # the end token's hash

SHARDS = "shard long, docs binary, flags binary, sizes binary, vocabulary binary, tokens binary, train_tokens long, pairs long"
REQUESTS = ("bucket int, shard long, words binary, word_counts binary, runs binary, hot binary, hot_runs binary, "
            "nexts binary, pair_counts binary")
ANSWERS = ("bucket int, shard long, word_totals binary, word_types binary, pair_totals binary, distinct_words long, once long, "
           "twice long, hot array<long>, hot_types array<long>")
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _short(hashes: np.ndarray) -> bytes:
    """The low 48 bits: enough to tell the successors of one context apart."""
    return np.ascontiguousarray(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
                                      [n for n, _ in fields])


def held_out(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return np.fromiter((v and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT
                        for i, v in zip(ids.tolist(), valid.tolist(), strict=True)), bool, len(ids))


class _Open:
    """A shard that texts are still added to."""

    def __init__(self):
        self.docs, self.valid, self.sizes, self.hashes, self.bytes = [], [], [], [], 0

    def add(self, docs: np.ndarray, valid: np.ndarray, w: tx.Words) -> None:
        n = np.diff(w.bounds)
        out = np.full(len(w.hashes) + len(n), END)
        out[np.arange(len(w.hashes)) + np.repeat(np.arange(len(n)), n)] = w.hashes
        for column, value in ((self.docs, docs), (self.valid, valid), (self.sizes, n + 1), (self.hashes, out)):
            column.append(value)
        self.bytes += len(w.data)

    def row(self) -> tuple:
        docs, valid, sizes, hashes = map(np.concatenate, (self.docs, self.valid, self.sizes, self.hashes))
        held = held_out(docs, valid)
        codes, vocabulary = pd.factorize(hashes)
        counts = np.bincount(codes)
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        tokens, vocabulary = rank[codes], vocabulary[order]
        pairs = len(pd.unique(_pairs(tokens, sizes, vocabulary)))
        number = zlib.crc32(docs.tobytes()) << 31 ^ zlib.crc32(hashes.tobytes())
        return (number, docs.tobytes(), np.concatenate([held, valid]).tobytes(), _pack(sizes), vocabulary.tobytes(),
                _pack(tokens), int(sizes[~held].sum()), pairs)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """For each token: (number of the word before, or of the end token) * vocabulary size + its own number."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = np.flatnonzero(vocabulary == END)[0]
    return before * len(vocabulary) + tokens


def _code(batches) -> Iterator[pa.RecordBatch]:
    shard = _Open()
    for batch in batches:
        ids = batch.column(0)
        valid = np.array(ids.is_valid(), bool)
        docs = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, w in tx.batches_of_words(batch.column(1)):
            shard.add(docs[i:j], valid[i:j], w)
            if shard.bytes >= SHARD:
                yield _batch(SHARDS, [shard.row()])
                shard = _Open()
    if shard.sizes:
        yield _batch(SHARDS, [shard.row()])


class _Coded:
    """A shard read back: distinct words, tokens by number, and the distinct bigrams in the order of their contexts."""

    def __init__(self, row: dict):
        self.docs, self.sizes = np.frombuffer(row["docs"], np.int64), _unpack(row["sizes"]).astype(np.int64)
        flags = np.frombuffer(row["flags"], bool)
        self.held, self.valid = flags[:len(self.docs)], flags[len(self.docs):]
        self.vocabulary = np.frombuffer(row["vocabulary"], tx.U64)
        self.tokens = _unpack(row["tokens"]).astype(np.int64)
        self.pairs, self.place = np.unique(_pairs(self.tokens, self.sizes, self.vocabulary), return_inverse=True)
        self.context, self.next = np.divmod(self.pairs, len(self.vocabulary))

    def by_bucket(self, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(bucket, words, pairs of these contexts, pairs of hot contexts)``, numbers in a fixed order.

        A bigram is counted where its context is; that of a hot context by a hash of both words.
        """
        size = tx.U64(buckets)
        own = (tx.mix(self.vocabulary) % size).astype(np.int64)
        spread = np.isin(self.vocabulary, hot)[self.context]
        plain, hot_pairs = np.flatnonzero(~spread), np.flatnonzero(spread)
        with np.errstate(over="ignore"):
            far = (tx.mix(self.vocabulary[self.context[hot_pairs]] + tx.mix(self.vocabulary[self.next[hot_pairs]])) % size).astype(np.int64)
        parts = []
        for ids, of in ((np.arange(len(own)), own), (plain, own[self.context[plain]]), (hot_pairs, far)):
            order = np.argsort(of, kind="stable")
            parts.append((ids[order], of[order]))
        for b in np.unique(np.concatenate([of for _, of in parts])).tolist():
            yield b, *(ids[np.searchsorted(of, b):np.searchsorted(of, b, "right")] for ids, of in parts)


def _heavy(share: float) -> Callable:
    """Contexts with more than ``share`` of a shard's training tokens, and how many they have."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes = _unpack(row["tokens"]), _unpack(row["sizes"])
                held = np.frombuffer(row["flags"], bool)[:len(sizes)]
                counts = np.bincount(tokens[np.repeat(~held, sizes)])
                words = np.frombuffer(row["vocabulary"], np.int64)
                some = np.flatnonzero(counts > share * counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array(words[some]), pa.array(counts[some].astype(np.int64))], ["word", "n"])
    return run


def _ask(hot: np.ndarray, buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _Coded(row)
                use = np.repeat(~s.held, s.sizes)
                words = np.bincount(s.tokens[use], minlength=len(s.vocabulary))
                pairs = np.bincount(s.place[use], minlength=len(s.pairs))
                for b, w, p, h in s.by_bucket(hot, buckets):
                    runs = np.diff(np.searchsorted(s.context[p], w, "left"), append=len(p)) if len(w) else np.zeros(0, np.int64)
                    contexts, hot_runs = np.unique(s.context[h], return_counts=True)
                    both = np.concatenate([p, h])
                    yield _batch(REQUESTS, [(b, row["shard"], s.vocabulary[w].tobytes(), _pack(words[w]), _pack(runs),
                                             s.vocabulary[contexts].tobytes(), _pack(hot_runs),
                                             _short(s.vocabulary[s.next[both]]), _pack(pairs[both]))])
    return run


def _answer(_, rows):
    """Sums one bucket over all shards; what a shard gets is in the order in which it asked."""
    rows = rows.to_pylist()
    words = [np.frombuffer(r["words"], tx.U64) for r in rows]
    hot = [np.frombuffer(r["hot"], tx.U64) for r in rows]
    contexts = [np.concatenate([np.repeat(w, _unpack(r["runs"])), np.repeat(h, _unpack(r["hot_runs"]))])
                for r, w, h in zip(rows, words, hot, strict=True)]
    sizes = [(len(w), len(c)) for w, c in zip(words, contexts, strict=True)]
    context = np.concatenate(contexts)
    del contexts
    with np.errstate(over="ignore"):
        ids = tx.mix(context * tx.U64(0x2545F4914F6CDD1D) + tx.mix(np.concatenate([_long(r["nexts"]) for r in rows])))
    place, pairs = pd.factorize(ids)
    del ids
    totals = np.bincount(place, np.concatenate([_unpack(r["pair_counts"]) for r in rows]), len(pairs)).astype(np.int64)
    of_pair = np.zeros(len(pairs), tx.U64)
    of_pair[place] = context
    word_place, vocabulary = pd.factorize(np.concatenate(words))
    counts = np.bincount(word_place, np.concatenate([_unpack(r["word_counts"]) for r in rows]), len(vocabulary)).astype(np.int64)
    known, types = np.unique(of_pair[totals > 0], return_counts=True)
    at = np.minimum(np.searchsorted(known, vocabulary), max(len(known) - 1, 0))
    seen = np.where(known[at] == vocabulary, types[at], 0) if len(known) else np.zeros(len(vocabulary), np.int64)
    spread = np.isin(known, np.unique(np.concatenate(hot)))
    summary = (int((counts > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum()),
               known[spread].view(np.int64).tolist(), types[spread].tolist())
    out, w_at, p_at = [], 0, 0
    for r, (w, p) in zip(rows, sizes, strict=True):
        which = word_place[w_at:w_at + w]
        out.append((r["bucket"], r["shard"], _pack(counts[which]), _pack(seen[which]), _pack(totals[place[p_at:p_at + p]]),
                    *(summary if not out else (0, 0, 0, [], []))))
        w_at, p_at = w_at + w, p_at + p
    return pa.Table.from_batches([_batch(ANSWERS, out)])


class Automaton:
    """The part of the automaton that one shard can reach, and its traversal."""

    def __init__(self, counts: np.ndarray, types: np.ndarray, arcs: np.ndarray, contexts: np.ndarray,
                 discount: float, tokens: int, distinct: int):
        self.single = (counts + 1.0) / (tokens + distinct + 1.0)
        self.is_state = counts > 0
        some = np.maximum(counts, 1)
        self.failure = discount * types / some
        self.arc = np.maximum(arcs - discount, 0.0) / some[contexts]

    def scores(self, tokens: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
        """log10 probability of each text. All texts advance together, a token a step, each in its own state."""
        order = np.argsort(-sizes, kind="stable")
        first, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        total, state = np.zeros(len(sizes)), np.full(len(sizes), start if self.is_state[start] else -1)
        active, steps = len(sizes), int(length[0]) if len(length) else 0
        for i in range(steps):
            while length[active - 1] <= i:
                active -= 1
            at = first[:active] + i
            word, here = tokens[at], state[:active]
            p = self.single[word]
            known = here >= 0
            p = np.where(known, self.arc[pairs[at]] + self.failure[here] * p, p)
            total[:active] += np.log10(p)
            state[:active] = np.where(self.is_state[word], word, -1)
        out = np.empty(len(sizes))
        out[order] = total
        return out


def _score(hot: np.ndarray, hot_types: np.ndarray, buckets: int, discount: float, tokens: int, distinct: int) -> Callable:
    def run(_, shards, answers):
        asked = {r["bucket"]: r for r in answers.to_pylist()}
        out = []
        for row in shards.to_pylist():  # shards with equal contents share a number, and the answers
            s = _Coded(row)
            counts, types = np.zeros(len(s.vocabulary), np.int64), np.zeros(len(s.vocabulary), np.int64)
            arcs = np.zeros(len(s.pairs), np.int64)
            for b, w, p, h in s.by_bucket(hot, buckets):
                counts[w], types[w] = _unpack(asked[b]["word_totals"]), _unpack(asked[b]["word_types"])
                arcs[np.concatenate([p, h])] = _unpack(asked[b]["pair_totals"])
            for w, t in zip(hot, hot_types, strict=True):
                types[s.vocabulary == w] = t
            part = Automaton(counts, types, arcs, s.context, discount, tokens, distinct)
            begin = np.cumsum(s.sizes) - s.sizes
            base = np.add.reduceat(np.log10(part.single)[s.tokens], begin)
            known = np.add.reduceat(part.is_state[s.tokens].astype(np.int64), begin)
            score = part.scores(s.tokens, s.place, s.sizes, int(np.flatnonzero(s.vocabulary == END)[0]))
            ids = pa.array(s.docs, mask=~s.valid)
            out.append(pa.RecordBatch.from_arrays(
                [ids, pa.array(s.held), pa.array(s.sizes), pa.array(known), pa.array(np.full(len(s.docs), tokens, np.int64)),
                 pa.array(base), pa.array(score)], [f.split()[0] for f in SCORES.split(", ")]))
        return pa.Table.from_batches(out, pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k])
                                                     for n, k in (f.split() for f in SCORES.split(", "))]))
    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model score of every text; the model learns from those that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = stored(rows.mapInArrow(_code, SHARDS), "shards")
    size = shards.agg(F.sum("train_tokens").alias("tokens"), F.sum("pairs").alias("pairs")).first()
    tokens, buckets = size["tokens"] or 0, max(1, -(-(size["pairs"] or 0) // ENTRIES))
    share = 1 / (4 * buckets)
    heavy = (shards.select("flags", "sizes", "vocabulary", "tokens").mapInArrow(_heavy(share), "word long, n long")
             .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > share * tokens))  # at most 4 * buckets rows
    hot = np.sort(np.array([r["word"] for r in heavy.collect()], np.int64).view(tx.U64)) if buckets > 1 else np.zeros(0, tx.U64)
    answers = stored(shards.mapInArrow(_ask(hot, buckets), REQUESTS).groupBy("bucket").applyInArrow(_answer, ANSWERS), "answers")
    total = answers.agg(*(F.sum(c).alias(c) for c in ("distinct_words", "once", "twice"))).first()
    spread = {r["word"]: r["types"] for r in answers.select(F.explode(F.arrays_zip("hot", "hot_types")).alias("h"))
              .groupBy(F.col("h.hot").alias("word")).agg(F.sum("h.hot_types").alias("types")).collect()}
    hot_types = np.array([spread.get(w, 0) for w in hot.view(np.int64).tolist()], np.int64)
    once, twice = total["once"] or 0, total["twice"] or 0
    discount = once / (once + 2 * twice) if once and twice else 0.5
    run = _score(hot, hot_types, buckets, discount, tokens, total["distinct_words"] or 0)
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, SCORES)
