"""Periodic runs of words by a dictionary of basic factors.

The dictionary names every factor (stretch of words) whose length is a power of two: one word first, then each pair of
neighbouring factors by the pair of their names. Two places have equal factors exactly if they have equal names.

1. *Successors.* Per length, places with one name are sorted; the next place with that name is a place's successor.
2. *Progressions.* In a run of period ``q``, occurrences of a factor of at least ``q`` words are ``q`` apart and no closer:
   successors form an arithmetic progression, for each of the run's consecutive places. So consecutive places whose
   successors are ``q`` apart propose a run of that period. A period is read off at the first power of two that isn't below
   it, where a run of three periods has such places, and nowhere else.
3. *Extent.* The last of these places, its successor and the factor end the run, as the next word would prolong the
   stretch of places; the same holds before the first. Neither end has words left to compare, no run is found twice, and
   the period is the smallest, as a smaller one would be a nearer successor.

Factors that occur once are dropped with all longer ones that hold them, so prose costs little more than its
single words. A slice of texts is handled at once; its memory is proportional to the slice, or to a longer text.
No row meets another: there is nothing to shuffle and no group that could be hot.

* words are maximal runs of characters other than ASCII white space, and compared by case (as 64-bit hashes, see
  :mod:`pulsegrid.llm.text`);
* null, empty or blank text: no words, no runs, the collapsed text is empty; repeated rows and null ids are rows like others;
* texts are read whole; columns other than the id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx

LEAST = 24  # words of a run
TIMES = 3  # periods of a run; the argument above needs three

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def repetitions(keys: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs, by start and period.

    ``keys`` has a number for each word, equal for equal words of one text and different in other texts; ``ends`` has the
    place where the word's text ends.
    """
    found = [np.zeros((3, 0), np.int64)]
    name = np.full(len(keys), -1, np.int64)
    at, size = np.arange(len(keys)), 1
    while len(at):
        order = np.argsort(keys, kind="stable")  # places stay in order within a name
        place, keys = at[order], keys[order]
        same = keys[1:] == keys[:-1]
        gap = np.diff(place)
        near = same & (gap <= size) & (2 * gap > size)
        found.append(_progressions(place[:-1][near], gap[near], size, least))
        again = np.append(same, False) | np.append(False, same)
        named = place[again]
        name[named] = np.cumsum(np.append(True, ~same))[again]
        at = np.sort(named)
        at = at[at + 2 * size <= ends[at]]
        at = at[name[at + size] >= 0]
        keys = name[at] * (len(name) + 1) + name[at + size]
        name[named] = -1  # names are of one length only
        size *= 2
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _progressions(place: np.ndarray, gap: np.ndarray, size: int, least: int) -> np.ndarray:
    """Runs that stretches of consecutive places with one gap propose and their last factor ends."""
    order = np.argsort(place)
    place, gap = place[order], gap[order]
    first = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(gap) != 0))) if len(place) else np.zeros(0, int)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    start, period = place[first], gap[first]
    length = place[last] - start + period + size
    long = length >= np.maximum(least, TIMES * period)
    return np.stack([start[long], length[long], period[long]])


def repeated(start: np.ndarray, length: np.ndarray, period: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words a run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def _find(least: int) -> Callable:
    def run(batches):
        for batch in batches:
            for i, j, w in tx.batches_of_words(batch.column("text"), lower=False):
                counts = np.diff(w.bounds)
                with np.errstate(over="ignore"):
                    keys = tx.mix(w.hashes + tx.mix(np.repeat(np.arange(j - i, dtype=np.uint64), counts)))
                start, length, period = repetitions(keys, np.repeat(w.bounds[1:], counts), least)
                gone = repeated(start, length, period, len(keys))
                of = np.searchsorted(w.bounds, start, "right") - 1
                # texts without words share their bound with the next one, which "right" skips
                offsets = np.searchsorted(of, np.arange(j - i + 1))
                runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start - w.bounds[of], length, period)],
                                                  ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                     pa.array(_kept(w, gone, batch.column("text")[i:j]), pa.string())], ["doc_id", "n_words", "runs", "text"])
    return run


def _kept(w: tx.Words, gone: np.ndarray, texts: pa.Array):
    """The words that are left of each text, joined by one space."""
    for k, text in enumerate(texts):
        words = (text.as_py() or "").encode().split()  # bytes are split at ASCII white space only
        out = gone[w.bounds[k]:w.bounds[k + 1]]
        yield b" ".join(compress(words, ~out) if out.any() else words).decode()


def collapse(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, text`` of each row.

    ``runs`` are all stretches of at least ``least`` words and three periods that no neighbouring word prolongs, as start (a word's
    number), length and smallest period, by start and period. ``text`` holds, joined by spaces, the words that no
    run contains after its first period.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(least), FOUND)
