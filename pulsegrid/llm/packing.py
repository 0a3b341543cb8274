"""Packing documents into training sequences by best-fit decreasing.

A document is tokenised, ended with a separator id, and cut into full windows first; what is left over is
placed, longest first, into the open window whose remaining capacity is the smallest that still holds it. A
segment tree over the capacities 0..window finds that capacity in logarithmic time.

Best-fit decreasing orders all pieces, so it runs on groups of about ``GROUP`` pieces that Spark deals out by
a hash of the document; a group leaves a partly filled window or two, which at that size is next to nothing.
Only lengths are moved, never the ids. Rows out are the same on every run and on any retry.

:func:`pack_in_order` keeps to the order of a table: its groups are consecutive stretches of ``STRETCH`` pieces, and
the windows of each are numbered by their first piece, so sequence ids follow the table. A group still leaves only a
partly filled window or two, one in a few hundred.

* null text: empty, i.e. the separator alone; empty tables give no rows;
* ties: pieces of equal length go by document id and start, windows of equal capacity by the last one opened;
* repeated document ids: every row is packed, as its own document;
* texts of any length: tokenised whole; extra columns are left out of the result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx
from pulsegrid.llm.mixing import ranks
from pulsegrid.llm.store import stored

WINDOW = 2048
SEPARATOR = 1
GROUP = 50_000
STRETCH = 1024
CACHE = 400_000  # distinct words a worker remembers the ids of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


CHUNK = 200  # words to a call of the tokenizer
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:%*&$#")] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tx.Words:
    """Words, cut once more where a run of ASCII letters or digits ends at a punctuation mark.

    The vocabulary's pattern ends a match at both places whatever stands around, so the ids of a text are those
    of its units. A-Z are lower-cased, as the vocabulary does, unless special tokens might stand in the text.
    """
    special = data.tobytes().find(b"<|") >= 0
    data = data if special else tx.LOWER[data]
    starts, ends = tx.spans(data, offsets)
    cut = np.flatnonzero(_ALNUM[data[:-1]] & _MARK[data[1:]]) + 1
    cut = cut[~np.isin(cut, offsets)]
    return tx.hashed(data, offsets, np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut])))


class WordIds:
    """Ids of units by hash. New ones are sorted in after every slice; beyond ``CACHE``, all are forgotten."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(names.values()) + 1, bool)  # ids that end a match of the pattern
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, tx.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words that are letters only: one match each, so many go in one call."""
        flat, counts = [], []
        for i in range(0, len(texts), CHUNK):
            some = texts[i:i + CHUNK]
            ids = self._encode([" ".join(some)])[0]
            count = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(count) != len(some):  # letters that normalise to something else
                each = self._encode(some)
                ids, count = np.concatenate(each), np.array([len(x) for x in each])
            flat.append(ids)
            counts.append(count)
        return np.concatenate(flat or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        alpha = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        ids, count = self._letters([t for t, a in zip(texts, alpha, strict=True) if a])
        each = self._encode([t for t, a in zip(texts, alpha, strict=True) if not a])
        new = np.concatenate([ids, *each])
        counts, first = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        counts[alpha], counts[~alpha] = count, [len(x) for x in each]
        order = np.concatenate([np.flatnonzero(alpha), np.flatnonzero(~alpha)])
        first[order] = self.used + np.cumsum(counts[order]) - counts[order]
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(new)] = new
        self.used += len(new)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = (np.insert(a, at, b) for a, b in (
            (self.keys, keys), (self.first, first), (self.count, counts)))

    def encode(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has."""
        unique, where, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if not len(unique):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.keys) > CACHE:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            self._learn(unique[new], w.texts(where[new]))
        at = np.searchsorted(self.keys, unique)
        first, count = self.first[at][inverse], self.count[at][inverse]
        ends = np.cumsum(count)
        return self.ids[np.arange(ends[-1]) + np.repeat(first - ends + count, count)], count


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """One table for each worker process."""
    return WordIds(vocabulary)


def tokenised(column: pa.Array, ids: WordIds) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ids)`` of each text, without special tokens."""
    data, offsets = tx.buffers(column)
    for i, j in tx.slices(offsets):
        w = units(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        flat, count = ids.encode(w)
        ends = np.concatenate([[0], np.cumsum(count)])[w.bounds]
        for k in range(j - i):
            yield i + k, flat[ends[k]:ends[k + 1]]


def _pieces(vocabulary: str, window: int, separator: int) -> Callable:
    def run(batches):
        words = word_ids(vocabulary)
        for batch in batches:
            doc, out, more = batch.column(0).to_pylist(), [], batch.num_columns - 2  # a place, or nothing
            places = batch.column(2).to_pylist() if more else None
            for row, ids in tokenised(batch.column(1), words):
                ids = np.append(ids, separator).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    out.append((doc[row], start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([places[row]] if more else [])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * (5 + more))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"][:5 + more])
    return run


def pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, separator: int = SEPARATOR, place: Column | None = None) -> DataFrame:
    """One row per full window and per remainder of each document; with its document's ``place`` if that is given."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([] if place is None else [place.cast("long").alias("place")]))
    return rows.mapInArrow(tx.tidy(_pieces(vocabulary, window, separator)), PIECES if place is None else PIECES + ", place long")


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities that have one."""

    def __init__(self, window: int):
        self.window, self.number = window, 0
        self.size = 1 << (window + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.stacks: list[list] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, capacity: int, window: tuple[int, int]) -> None:
        if capacity:
            self.stacks[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open window has."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:  # up to the first right sibling with something in it, then down to its leftmost leaf
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """Window number and offset of the next piece; pieces come longest first."""
        capacity = self.tightest(length)
        if capacity is None:
            capacity, at, used = self.window, self.number, 0
            self.number += 1
        else:
            self._add(capacity, -1)
            at, used = self.stacks[capacity].pop()
        self.put(capacity - length, (at, used + length))
        return at, used


def _pack_groups(window: int) -> Callable:
    def run(batches):
        group, opened = None, None
        for batch in batches:  # rows come sorted: group, then longest first
            sequence, offsets = [], []
            for g, length in zip(batch.column("bin_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, opened = g, OpenWindows(window)
                at, used = opened.place(length)
                sequence.append((g << 36) + at)
                offsets.append(used)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                + [pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(cut: DataFrame, *, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Sequences for pieces of at most ``window`` tokens; sequence ids are group * 2^36 + window number."""
    cut = stored(cut, "pieces")  # thin rows; the number of groups depends on how many there are
    groups = max(1, -(-cut.count() // group))
    row = F.monotonically_increasing_id()  # of the table just written: repeated and null ids are dealt like any others
    dealt: Column = F.pmod(F.xxhash64(row), F.lit(groups))
    ordered = (cut.withColumn("bin_group", dealt).repartition("bin_group")
               .sortWithinPartitions("bin_group", F.desc("length"), "doc_id", "start", "ids_crc32"))
    return ordered.mapInArrow(_pack_groups(window), PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, *, window: int = WINDOW, separator: int = SEPARATOR,
                   group: int = GROUP) -> DataFrame:
    return pack(pieces(docs, vocabulary, window=window, separator=separator), window=window, group=group)


def _pack_stretches(window: int) -> Callable:
    names = [f.split()[0] for f in PIECES.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        """A group's rows, its windows numbered by their first piece."""
        opened, put, first = OpenWindows(window), [], {}
        for *_, length, _, _, place, start in rows:
            at, used = opened.place(length)
            put.append((at, used))
            first[at] = min(first.get(at, (place, start)), (place, start))
        number = {at: k for k, at in enumerate(sorted(first, key=first.get))}
        out = [(doc, start, length, crc, tokens, (g << 36) + number[at], used)
               for (g, doc, length, crc, tokens, _, start), (at, used) in zip(rows, put, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [*names, "sequence_id", "offset"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:  # rows come sorted: group, then longest first
            columns = ("bin_group", "doc_id", "length", "ids_crc32", "doc_tokens", "place", "start")
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield packed(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield packed(rows)
    return run


def place_in_table(docs: DataFrame) -> Column:
    """File and row position of a Parquet table's rows, as one ascending number; of other rows, Spark's own order."""
    try:
        files = [r[0] for r in docs.select("_metadata.file_path", "_metadata.row_index").select("file_path").distinct().collect()]
    except AnalysisException:
        return F.monotonically_increasing_id()
    order = sorted(files, key=lambda f: (len(f), f))  # part numbers grow by a digit
    known = F.from_json(F.lit(json.dumps(order)), "array<string>")
    return (F.array_position(known, F.col("_metadata.file_path")) * F.lit(1 << 40)) + F.col("_metadata.row_index")


def pack_in_order(docs: DataFrame, vocabulary: str, *, window: int = WINDOW, separator: int = SEPARATOR,
                  group: int = STRETCH) -> DataFrame:
    """As :func:`pack_documents`, in groups of consecutive pieces; sequence ids follow the rows of the table."""
    cut = pieces(docs, vocabulary, window=window, separator=separator, place=place_in_table(docs))
    ranked = ranks(cut.withColumn("_source", F.lit("")), ["place", "start"])
    ordered = (ranked.withColumn("bin_group", F.floor(F.col("_rank") / group)).drop("_source", "_rank").repartition("bin_group")
               .sortWithinPartitions("bin_group", F.desc("length"), "place", "start"))
    return ordered.mapInArrow(_pack_stretches(window), PACKED)
