"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends; a paragraph of more than ``LONG`` words is cut further before each
word whose hash falls into one class of ``ANCHOR``, so an edit moves only the cuts beside it. The ``n``-th
occurrence of a paragraph in a text has a digest of its own, so a text is a set of 64-bit digests. A digest goes into
one cell of each of ``HASHES`` stripes; a cell holds how many there are, the sum of the digests (modulo 2^64) and
that of their checksums (modulo 2^32).

Subtracting two sketches cell by cell leaves only the digests that the texts don't share. Peeling reads a cell
that holds a single digest (count 1 or -1 and a fitting checksum), takes it out of its other cells, and goes on
until nothing is left; if something stays, both sketches are built again with four times the cells. The
likeness of two texts is the Jaccard index that follows from the sizes and the number of digests peeled.
All pairs of a batch are peeled together, in array operations.

Written cells have counts of 32 bits, sums of 64 and checksums of 32. Sketches hold sums, so equal texts have equal fingerprints whatever the batch. ``fingerprint`` is the smallest
sketch with the number of paragraphs in front.

* null text: empty, no paragraphs; two texts without paragraphs have likeness 1, one without and one with 0;
* ties: rows with one document id follow each other in the order of their texts, as if ids were distinct;
* null ids come first; a table of one row follows itself; an empty table gives no rows;
* texts are read whole; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx
from pulsegrid.llm.store import stored

LONG = 12  # words of a paragraph that is left whole
ANCHOR = 8
HASHES = 3
CELLS = 24
GROWTH = 4
PAIRS = 512  # texts that are compared at a time
RANGE = 5000  # texts in a range of ids, about

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts and the bounds of each text."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends = tx.spans(data, offsets)
    w = tx.hashed(data, offsets, starts, ends)
    n = len(starts)
    if not n:
        return np.zeros(0, tx.U64), np.zeros(len(texts) + 1, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])[starts]
    fresh = np.ones(n, bool)
    fresh[1:] = (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(first, append=n)
    fresh |= np.repeat(size > LONG, size) & (w.hashes % tx.U64(ANCHOR) == 0)
    first = np.flatnonzero(fresh)
    with np.errstate(over="ignore"):  # a paragraph: its words in order
        position = (np.arange(n) - np.repeat(first, np.diff(first, append=n))).astype(tx.U64)
        paragraph = tx.mix(np.add.reduceat(tx.mix(w.hashes + position * tx.U64(0x9E3779B97F4A7C15)), first))
    owner = doc[first]
    order = np.lexsort((paragraph, owner))
    paragraph, owner = paragraph[order], owner[order]
    new = np.ones(len(first), bool)
    new[1:] = (paragraph[1:] != paragraph[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    nth = (np.arange(len(first)) - np.repeat(begin, np.diff(begin, append=len(first)))).astype(tx.U64)
    with np.errstate(over="ignore"):
        digest = tx.mix(paragraph + nth * tx.U64(0xD1B54A32D192ED03))
    return digest, np.searchsorted(owner, np.arange(len(texts) + 1))


def checksum(digest: np.ndarray) -> np.ndarray:
    return tx.mix(digest ^ tx.U64(0x5851F42D4C957F2D)) >> tx.U64(32)


def places(digest: np.ndarray, cells: int) -> np.ndarray:
    """A cell in each stripe; ``cells`` is a multiple of ``HASHES``."""
    stripe = tx.U64(cells // HASHES)
    with np.errstate(over="ignore"):
        return np.stack([(tx.mix(digest + tx.U64(k + 1 << 50)) % stripe + tx.U64(k) * stripe) for k in range(HASHES)]).astype(np.int64)


def _add(cells: tuple[np.ndarray, ...], at: np.ndarray, digest: np.ndarray, sign: np.ndarray) -> None:
    """Adds signed digests to the cells at ``at`` (a row per stripe)."""
    where, times = at.ravel(), sign.astype(tx.U64)
    with np.errstate(over="ignore"):
        for array, value in zip(cells, (sign, digest * times, checksum(digest) * times), strict=True):
            np.add.at(array, where, np.tile(value, HASHES))


def sketches(digest: np.ndarray, owner: np.ndarray, sign: np.ndarray | int, n: int, cells: int) -> tuple[np.ndarray, ...]:
    """Counts, sums and sums of checksums of ``n`` sketches side by side."""
    out = np.zeros(n * cells, np.int64), np.zeros(n * cells, tx.U64), np.zeros(n * cells, tx.U64)
    _add(out, owner * cells + places(digest, cells), digest, np.broadcast_to(np.asarray(sign, np.int64), owner.shape))
    return out


LOW = tx.U64(0xFFFFFFFF)


def peel(sketch: tuple[np.ndarray, ...], n: int, cells: int, limit: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Whether each of ``n`` subtracted sketches came apart, how many digests it held, and these (owner, digest).

    ``limit`` is how many digests there can be: beyond it something was taken for a digest that is none.
    """
    counts, sums, checks = sketch
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, tx.U64)]
    held, taken = np.zeros(n, np.int64), 0
    look = np.arange(len(counts))
    while len(look) and taken <= limit:
        one = look[np.abs(counts[look]) == 1]
        with np.errstate(over="ignore"):
            sign = counts[one].astype(tx.U64)
            digest, check = sums[one] * sign, checks[one] * sign & LOW
        fits = checksum(digest) == check
        one, digest = one[fits], digest[fits]
        own = one // cells
        order = np.lexsort((digest, own))  # a digest may be alone in several cells
        one, digest, own = one[order], digest[order], own[order]
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != own[:-1]) | (digest[1:] != digest[:-1])
        one, digest, own = one[keep], digest[keep], own[keep]
        if not len(own):
            break
        at = own * cells + places(digest, cells)
        _add(sketch, at, digest, -counts[one])
        held += np.bincount(own, minlength=n)
        taken += len(own)
        owners.append(own)
        found.append(digest)
        look = np.unique(at)
    left = ((counts != 0) | (sums != 0) | (checks & LOW != 0)).reshape(n, cells).any(axis=1)
    return ~left, held, (np.concatenate(owners), np.concatenate(found))


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Digests that the i-th text of ``a`` and of ``b`` don't share: subtract, peel, retry larger."""
    n = len(a[1]) - 1
    out = np.zeros(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        parts = []
        for (digest, bounds), sign in ((a, 1), (b, -1)):
            size = bounds[todo + 1] - bounds[todo]
            owner = np.repeat(np.arange(len(todo)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[todo], size)
            parts.append((digest[at], owner, np.full(len(at), sign)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        done, held, _ = peel(sketches(*joined, len(todo), cells), len(todo), cells, len(joined[0]))
        out[todo[done]] = held[done]
        todo, cells = todo[~done], cells * GROWTH
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    total, apart = np.diff(a[1]) + np.diff(b[1]), differing(a, b)
    return np.where(total == 0, 1.0, (total - apart) / np.maximum(total + apart, 1))


def fingerprints(d: tuple[np.ndarray, np.ndarray]) -> list[str]:
    digest, bounds = d
    n = len(bounds) - 1
    size = np.diff(bounds)
    counts, sums, checks = sketches(digest, np.repeat(np.arange(n), size), 1, n, CELLS)
    cells = np.concatenate([a.view(np.uint8).reshape(-1, a.itemsize) for a in (
        counts.astype("<u4"), sums.astype("<u8"), (checks & LOW).astype("<u4"))], axis=1)
    rows = cells.reshape(n, -1)
    return [f"{k}:{base64.b64encode(r.tobytes()).decode()}" for k, r in zip(size.tolist(), rows, strict=True)]


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the next text's beginning, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(docs: list, texts: list[str], following: list[str]) -> list[list]:
    """The result columns for texts and the ones after them."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, other, new = digests(texts), digests(following), digests(changed)
    return [docs, [len(t) for t in texts], [hashlib.sha256(c.encode()).hexdigest() for c in changed],
            fingerprints(own), fingerprints(new), likeness(own, new).tolist(), likeness(own, other).tolist()]


def _in_order(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and id, each range ended by a copy of the text that follows it."""
    docs, ends, texts = [], [], []
    for batch in batches:
        for i in range(0, len(batch), PAIRS):
            some = batch.slice(i, PAIRS)
            docs += some.column("doc_id").to_pylist()
            ends += some.column("copy").to_pylist()
            texts += some.column("text").to_pylist()
            own = [k for k in range(len(texts) - 1) if not ends[k]]
            if own:
                columns = compare([docs[k] for k in own], [texts[k] for k in own], [texts[k + 1] for k in own])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, ARROW, strict=True)],
                                                 [f.split()[0] for f in RESULT.split(", ")])
            docs, ends, texts = docs[-1:], ends[-1:], texts[-1:]


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they say about these and the next text.

    Ids are cut into ranges of about ``RANGE`` texts at their quantiles. A text meets its successor in its range;
    to each range a copy of the first text of the next one is added, so texts are shuffled once and nothing is
    written in between. Driver and broadcast: a number per range.
    """
    first = -(1 << 63)  # null ids come first
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(first)))
    n = rows.count()
    ranges = max(1, -(-n // RANGE))
    cuts = [k / ranges for k in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("key", cuts, 100 * ranges).alias("b")).first()["b"] if n and cuts else []
    at = np.array(sorted(set(bounds or [])), np.int64)

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(), "right"))

    rows = rows.withColumn("range", range_of("key"))
    least = rows.groupBy("range").agg(F.min("key").alias("key"))
    heads = stored(rows.join(F.broadcast(least), ["range", "key"]).groupBy("range").agg(F.min("text").alias("text")), "heads")
    follows = heads.select((F.col("range") - 1).alias("range"), F.col("text").alias("follows"))  # only the first range can be empty
    begin = heads.orderBy("range").limit(1).select(F.col("text").alias("begin"))
    copies = heads.select("range").join(follows, "range", "left").crossJoin(F.broadcast(begin)).select(  # a single row on one side
        F.lit(None).cast("long").alias("doc_id"), F.coalesce("follows", "begin").alias("text"), F.lit(0).cast("long").alias("key"),
        "range", F.lit(1).alias("copy"))
    ordered = (rows.withColumn("copy", F.lit(0)).unionByName(copies).repartition(ranges, "range")
               .sortWithinPartitions("range", "copy", "key", "text"))
    return ordered.select("doc_id", "copy", "text").mapInArrow(_in_order, RESULT)
