"""License scan by ordered signature rules.

1. *Words.* A-Z are lower-cased; words are runs of letters, digits and non-ASCII characters, one space is put between them.
2. *Keyword prefilter.* An Aho-Corasick automaton reads the text once for the literals of all rules (:mod:`pulsegrid.llm.license_rules`).
   A match of a rule holds one of its literals, so the regular expressions of rules without one aren't tried.
3. *Suppression.* Detections are taken level by level: tags, sentences of license texts, grants, names, weak signs. One that lies
   inside the interval of a kept detection of a stronger level is dropped; within a level one inside a longer one, and of
   equal intervals all but the first rule's. So "licensed under the Apache License, Version 2.0" is one detection, not four.
   Detections that overlap only in part are kept.
4. *Base.* Places of plain phrases are found beside and never suppressed; the rules only add labels.

Interval containment takes a sort and running maxima, whatever the number of detections. A row is judged alone: nothing is shuffled.

* null, empty or blank text: no words, no places, no detections, score 0; repeated rows and null ids are rows like others;
* texts are read whole; columns other than the id and the text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.license_rules import CONFIDENCE, Rule, rules

#: Phrases and labels of the base.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASE_CONFIDENCE = 0.6

#: What a byte becomes: lower case, or a space if it is no part of a word.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PLACE = "struct<label:string,start:long,length:long>"
DETECTION = "struct<rule:string,label:string,start:long,length:long,confidence:double>"
SCANNED = f"doc_id long, n_words long, places array<{PLACE}>, detections array<{DETECTION}>, score double"


def normal(text: str) -> tuple[bytes, int]:
    """The words with one space between, before and after them, in UTF-8, and their number."""
    words = text.encode().translate(NORMAL).split()
    return b" " + b" ".join(words) + b" ", len(words)


def contained(start: np.ndarray, end: np.ndarray, kept_start: np.ndarray, kept_end: np.ndarray) -> np.ndarray:
    """Which intervals lie inside a kept one; the kept are sorted by start."""
    if not len(kept_start):
        return np.zeros(len(start), bool)
    reach = np.maximum.accumulate(kept_end)
    before = np.searchsorted(kept_start, start, "right")
    return (before > 0) & (reach[np.maximum(before, 1) - 1] >= end)


def resolved(start: np.ndarray, end: np.ndarray, level: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices of the detections that no stronger or longer one contains, by start."""
    kept = np.zeros(0, np.int64)
    for one in np.unique(level):
        some = np.flatnonzero(level == one)
        some = some[~contained(start[some], end[some], start[kept], end[kept])]
        some = some[np.lexsort((rank[some], -end[some], start[some]))]
        reach = np.maximum.accumulate(np.append(-1, end[some]))[:-1]  # of those that begin no later and rank before
        kept = np.concatenate([kept, some[end[some] > reach]])
        kept = kept[np.lexsort((end[kept], start[kept]))]
    return kept


class Scanner:
    """The rules, compiled, and the automaton of their literals; one per worker."""

    def __init__(self, signatures: list[Rule], phrases: dict[str, str]):
        self.rules = signatures
        self.patterns = [re.compile(b"(?<= )(?:%s)(?= )" % r.pattern.encode()) for r in signatures]
        self.phrases = [(label, len(p.split()), re.compile(b"(?<= )(?=%s )" % re.escape(p.encode()))) for p, label in phrases.items()]
        gates: dict[str, list[int]] = {}
        for k, r in enumerate(signatures):
            for literal in r.literals:
                gates.setdefault(literal, []).append(k)
        for k, p in enumerate(phrases):
            gates.setdefault(f" {p} ", []).append(len(signatures) + k)
        self.automaton = ahocorasick.Automaton()
        for literal, some in gates.items():
            self.automaton.add_word(literal.encode().decode("latin-1"), some)  # a character for each byte
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple:
        data, n = normal(text)
        tried = sorted({k for _, some in self.automaton.iter(data.decode("latin-1")) for k in some})
        if not tried:
            return n, [], [], 0.0
        borders = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # word i is between borders i and i + 1
        places, spans, by = [], [], []
        for k in tried:
            if k >= len(self.rules):
                label, length, pattern = self.phrases[k - len(self.rules)]
                places += [(label, int(np.searchsorted(borders, m.start()) - 1), length) for m in pattern.finditer(data)]
            else:
                found = [m.span() for m in self.patterns[k].finditer(data)]
                spans += found
                by += [k] * len(found)
        places.sort(key=lambda p: (p[1], p[0]))
        detections = []
        if spans:
            start, end = np.searchsorted(borders, np.array(spans).T)
            start -= 1
            rank = np.array(by)
            for i in resolved(start, end, np.array([self.rules[k].level for k in by]), rank).tolist():
                r = self.rules[by[i]]
                detections.append((r.name, r.label, int(start[i]), int(end[i] - start[i]), CONFIDENCE[r.level]))
        return n, places, detections, max([PHRASE_CONFIDENCE] * bool(places) + [d[-1] for d in detections], default=0.0)


def _scan(signatures: list[Rule] | None, phrases: dict[str, str]) -> Callable:
    def run(batches):
        scanner = Scanner(rules() if signatures is None else signatures, phrases)
        names, detail = ("label", "start", "length"), ("rule", "label", "start", "length", "confidence")
        types = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        details = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                                      ("confidence", pa.float64())]))
        for batch in batches:
            rows = [scanner(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([[dict(zip(names, p, strict=True)) for p in r[1]] for r in rows], types),
                 pa.array([[dict(zip(detail, d, strict=True)) for d in r[2]] for r in rows], details),
                 pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "n_words", "places", "detections", "score"])
    return run


def scan(docs: DataFrame, *, signatures: list[Rule] | None = None, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places, detections, score`` of each row.

    ``places`` are all places of the phrases (label, first word, number of words), ``detections`` what is left of the rules' matches
    (with rule and confidence), both by start; ``score`` is the confidence of the surest of all, 0 without any.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(signatures, phrases), SCANNED)
