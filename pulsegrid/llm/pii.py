"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from the four patterns below, leftmost and non-overlapping per kind; a match that fails its check
is dropped without a retry. The field adds spans that the patterns miss (spelled-out or bracketed addresses,
numbers in other formats): looser shapes propose segments of up to ``MAX_ATOMS`` atoms (runs of letters and
digits, or single other characters); features of the whole span (digits, checksum, separators, shape of the
host, the word before) score each segment with each kind; and a dynamic program over the atoms finds the
sequence of segments and single atoms with the largest total, so boundaries and kinds are chosen together.
An added span never overlaps a base span, and base spans always stay.

Training: log-likelihood of the field by gradient ascent, on at most ``SAMPLE`` base spans of the corpus with
their surroundings (those with the smallest hashes), as they are, rewritten to other formats, and spoilt
(wrong checksum, numbers out of range, too few digits), where nothing is to be found. Everything else covers all
texts. Documents are independent: no shuffle, and the weights are a few dozen numbers.

* null text: empty, no spans; texts are read whole; positions are code points, ends exclusive;
* spans of different kinds may overlap; ties between equal sequences go to fewer, then earlier spans;
* null ids and repeated rows are kept as they are; empty tables give no rows; extra columns are left out;
* a corpus without any base span: the field is trained on nothing and adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx
from pulsegrid.llm.store import stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 160
CONTEXT = 60  # code points of surroundings in training
MAX_ATOMS = 40
MARGIN = 1.0  # by which a segment must beat its atoms

# fixed values: the patterns that base spans are defined by, with a look-behind that only saves retries
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def at_most_255(digits: str) -> bool:
    """Whatever the number of leading zeros."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind in the fixed order, then by start."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(at_most_255(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = only_digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------------

ATOM = re.compile(r"[^\W_]+|.", re.S)
SHAPES = (
    re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\bat\b)\s?[A-Za-z0-9-]+"
               r"(?:\s?(?:\.|\[\s?dot\s?\]|\(\s?dot\s?\)|\[\.\]|\bdot\b)\s?[A-Za-z0-9-]+)+"),
    re.compile(r"(?<![\w.])[0-9]{1,3}(?:\[?\.\]?|\s?\[dot\]\s?)[0-9]{1,3}(?:\[?\.\]?|\s?\[dot\]\s?)[0-9]{1,3}(?:\[?\.\]?|\s?\[dot\]\s?)[0-9]{1,3}(?![\w])"),
    re.compile(r"(?<![\w+.])[+(]?[0-9](?:[\x20()./_-]{0,3}[0-9]){6,24}(?!\w)"),
)
NEEDS = (re.compile(r"(?i)@|\bat\b"), re.compile("[0-9]"), re.compile("[0-9]"))  # what any match of each shape holds
POSSIBLE = r"(?i)[0-9@]|\bat\b"  # what any span holds, by Arrow, whose \b knows only ASCII letters and so holds more often
CUES = {"email": {"mail", "email", "e-mail", "contact", "write"}, "phone": {"tel", "phone", "call", "fax", "mobile"},
        "card": {"card", "visa", "mastercard"}, "ip": {"ip", "host", "address", "from"}}
FEATURES = ("bias", "at", "spelled_at", "spelled_dot", "rich_local", "known_tld", "quads", "quads_small", "luhn", "digits_card",
            "digits_phone", "plus", "parens", "dashes", "groups34", "cue", "letters", "odd_separator")
WIDTH = len(FEATURES)


def proposals(text: str) -> list[tuple[int, int]]:
    """Looser spans; of a number in groups, also its runs of whole groups."""
    out = set()
    for need, shape in zip(NEEDS, SHAPES, strict=True):
        for m in shape.finditer(text) if need.search(text) else ():
            out.add(m.span())
            if shape is SHAPES[2]:
                groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer(r"\+?\(?[0-9]+", m.group())]
                for i in range(len(groups)):
                    for j in range(i, min(len(groups), i + 6)):
                        if 7 <= len(only_digits(text[groups[i][0]:groups[j][1]])) <= 19:
                            out.add((groups[i][0], groups[j][1]))
    return sorted(out)


def features(text: str, start: int, end: int) -> np.ndarray:
    """Of the whole span and the word before it; the same for every kind."""
    s = text[start:end]
    d = only_digits(s)
    low = s.lower()
    mail = re.split(r"\s?(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\bat\b)\s?", low, maxsplit=1)
    tail = re.findall(r"[a-z0-9-]+", mail[1])[-1] if len(mail) > 1 and re.search("[a-z0-9]", mail[1]) else ""
    quads = re.split(r"\s?\[?(?:\.|dot)\]?\s?", s)
    four = len(quads) == 4 and all(q.isdigit() for q in quads)
    before = re.findall(r"[\w-]+", text[max(0, start - 30):start].lower())
    letters = re.search("[A-Za-z]", s) is not None
    out = np.zeros(WIDTH)
    out[0] = 1
    out[1:] = [
        "@" in s, len(mail) > 1 and "@" not in s, "dot" in low, len(mail) > 1 and bool(re.search(r"[0-9._+]", mail[0])),
        tail in {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"},
        four, four and all(len(q) < 4 and int(q) <= 255 for q in quads),
        not letters and 13 <= len(d) <= 19 and luhn(d), not letters and 13 <= len(d) <= 19, not letters and 9 <= len(d) <= 12,
        s[0] == "+", "(" in s and ")" in s and not letters, "-" in s and not letters,
        not letters and bool(re.search(r"(?:^|\D)[0-9]{3}\D{1,2}[0-9]{4}$", s)), bool(before) and any(before[-1] in c for c in CUES.values()),
        letters and len(mail) < 2, not letters and bool(re.search(r"[/_]", s))]
    return out


class Lattice:
    """Atoms of a text and the segments proposed over them."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None):
        atoms = [m.span() for m in ATOM.finditer(text)]
        starts, ends = {a: i for i, (a, _) in enumerate(atoms)}, {b: i + 1 for i, (_, b) in enumerate(atoms)}
        self.n = len(atoms)
        self.segments = [(starts[a], ends[b], a, b) for a, b in (proposals(text) if spans is None else spans)
                         if a in starts and b in ends and ends[b] - starts[a] <= MAX_ATOMS]
        self.features = np.array([features(text, a, b) for *_, a, b in self.segments]).reshape(-1, WIDTH)


def _scores(x: Lattice, weights: np.ndarray) -> np.ndarray:
    return x.features @ weights.T  # segment by kind; an atom alone scores 0


def expected(x: Lattice, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """log of the sum over all segmentations, and the probability of each segment with each kind."""
    score = _scores(x, weights)
    begin, finish = {}, {}
    for k, (i, j, *_) in enumerate(x.segments):
        begin.setdefault(i, []).append(k)
        finish.setdefault(j, []).append(k)
    whole = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
    alpha, beta = np.zeros(x.n + 1), np.zeros(x.n + 1)
    for j in range(1, x.n + 1):
        alpha[j] = alpha[j - 1]
        for k in finish.get(j, ()):
            alpha[j] = np.logaddexp(alpha[j], alpha[x.segments[k][0]] + whole[k])
    for i in range(x.n - 1, -1, -1):
        beta[i] = beta[i + 1]
        for k in begin.get(i, ()):
            beta[i] = np.logaddexp(beta[i], beta[x.segments[k][1]] + whole[k])
    p = np.array([np.exp(alpha[i] + score[k] + beta[j] - alpha[-1]) for k, (i, j, *_) in enumerate(x.segments)]).reshape(-1, len(KINDS))
    return float(alpha[-1]), p


def best(x: Lattice, weights: np.ndarray, margin: float = MARGIN) -> list[Span]:
    """The segmentation with the largest total."""
    score = _scores(x, weights) - margin
    finish = {}
    for k, (_, j, *_) in enumerate(x.segments):
        finish.setdefault(j, []).append(k)
    total, back = np.zeros(x.n + 1), [None] * (x.n + 1)
    for j in range(1, x.n + 1):
        total[j] = total[j - 1]
        for k in finish.get(j, ()):
            kind = int(score[k].argmax())
            value = total[x.segments[k][0]] + score[k, kind]
            if value > total[j]:
                total[j], back[j] = value, (k, kind)
    out, j = [], x.n
    while j:
        if back[j] is None:
            j -= 1
        else:
            k, kind = back[j]
            i, _, a, b = x.segments[k]
            out.append((KINDS[kind], a, b))
            j = i
    return out[::-1]


def variants(kind: str, s: str, turn: int) -> list[tuple[str, str | None]]:
    """Rewritings of a base span with their kind, and spoilt ones with none."""
    d = only_digits(s)
    if kind == "email":
        local, _, host = s.partition("@")
        word = re.sub("[^a-z]", "", local.lower()) or "look"
        return [(f"{local} (at) {host}", kind), (f"{local} [at] {host.replace('.', ' [dot] ')}", kind),
                (f"{local} at {host.replace('.', ' dot ')}", kind), (f"{local} at {host}", kind),
                (f"{word} at {host.split('.')[0]}.then", None), (f"{word} at dot then", None)]
    if kind == "ip":
        return [(s.replace(".", "[.]"), kind), (s.replace(".", " [dot] "), kind),
                (".".join(str(int(p) + 300) for p in s.split(".")), None), (s.replace(".", "", 1), None)]
    if kind == "card":
        bad = d[:-1] + str((int(d[-1]) + 1 + turn % 8) % 10)
        quads = [d[i:i + 4] for i in range(0, len(d), 4)]
        return [(".".join(quads), kind), ("/".join(quads), kind), ("_".join(quads), kind), (bad, None),
                ("/".join(bad[i:i + 4] for i in range(0, len(bad), 4)), None), (d[:12], None)]
    n = d[-10:].rjust(10, "5")
    return [(f"({n[:3]}) {n[3:6]}-{n[6:]}", kind), (f"{n[:3]}-{n[3:6]}-{n[6:]}", kind), (f"{n[:3]}.{n[3:6]}.{n[6:]}", kind),
            (f"tel {n}", None), (n, None), (n[:7], None), (f"{n[:2]}/{n[2:4]}/{n[4:8]}", None), (f"{n[:4]}-{n[4:6]}-{n[6:8]}", None)]


def train(samples: list[tuple[str, str, str, str]], rounds: int = 120, rate: float = 0.7, shrink: float = 0.001) -> np.ndarray:
    """Weights by kind from ``(kind, span, before, after)``."""
    cases = []
    for turn, (kind, s, before, after) in enumerate(samples):
        for surface, label in [(s, kind), *variants(kind, s, turn)]:
            text = before + surface + after
            x = Lattice(text)
            at = (len(before), len(before) + len(surface))
            gold = np.zeros((len(x.segments), len(KINDS)))
            for k, (*_, a, b) in enumerate(x.segments):
                if label and (a, b) == at:
                    gold[k, KINDS.index(label)] = 1
            if x.segments and (not label or gold.any()):
                cases.append((x, gold))
    weights, square = np.zeros((len(KINDS), WIDTH)), np.full((len(KINDS), WIDTH), 1e-6)
    for _ in range(rounds if cases else 0):
        slope = -shrink * weights
        for x, gold in cases:
            slope += (gold - expected(x, weights)[1]).T @ x.features / len(cases)
        square += slope ** 2
        weights += rate * slope / np.sqrt(square)
    if not cases:
        weights[:, 0] = -math.inf
    return weights


def added(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans that the field finds beside the base spans: a lattice for each group of overlapping proposals."""
    if not np.isfinite(weights[0, 0]):
        return []
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    groups: list[list[tuple[int, int]]] = []
    reach = -1
    for a, b in proposals(text):
        k = bisect_left(starts, b) - 1  # the last base span that begins before the end
        if k >= 0 and taken[k][1] > a:
            continue
        if a > reach:
            groups.append([])
        groups[-1].append((a, b))
        reach = max(reach, b)
    out = []
    for group in groups:
        begin = max(0, group[0][0] - CONTEXT)
        window = text[begin:max(b for _, b in group) + 1]
        x = Lattice(window, [(a - begin, b - begin) for a, b in group])
        out += [(k, i + begin, j + begin) for k, i, j in best(x, weights)]
    return out


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by kind, then start."""
    base = base_spans(text)
    return base, sorted(base + added(text, base, weights), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Each text, or None where it can hold nothing: no pattern and no shape matches without a digit, ``@`` or the word at."""
    possible = pc.match_substring_regex(pc.fill_null(column, ""), POSSIBLE)
    for i in range(len(column)):
        yield column[i].as_py() if possible[i].as_py() else None


def _sample(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(4)]
        for text in _texts(batch.column(0)):
            for kind, a, b in base_spans(text) if text else ():
                for column, value in zip(out, (kind, text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["kind", "span", "before", "after"])


def fit(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The field's weights; at most ``sample`` base spans, evenly by kind, reach the driver."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_sample, "kind string, span string, before string, after string")
    found = stored(found.where("length(span) <= 200").withColumn("draw", F.xxhash64("kind", "span", "before", "after")), "spans")
    rows = [(r["kind"], r["span"], r["before"], r["after"]) for kind in KINDS for r in
            found.where(F.col("kind") == kind).orderBy("draw", "span", "before", "after").limit(sample // len(KINDS)).collect()]
    return train(rows)


def _find(weights: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                base, every = find(text, weights) if text else ([], [])
                rows.append((*(sum(k == kind for k, *_ in base) for kind in KINDS),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = [[r[k] for r in rows] for k in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                [f.split()[0] for f in RESULT.split(", ")])
    return run


def detect(docs: DataFrame, weights: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find(fit(rows) if weights is None else weights), RESULT)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans replaced by the kind of the first, as ``<EMAIL>``."""
    out, end, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[end:a], f"<{kind.upper()}>"]
        last = max(last, b)
        end = last
    return "".join(out) + text[end:]


def _redact(weights: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(_texts(batch.column(1))):
                if text:
                    texts[i] = redact(text, find(text, weights)[1])
            yield batch.set_column(1, batch.schema.names[1], pa.array(texts, pa.string()))
    return run


def redacted(docs: DataFrame, weights: np.ndarray | None = None, *, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in their texts; all other columns as they are."""
    order = [F.lit(0).alias("_first"), F.col(text_col), *[F.col(c) for c in docs.columns if c != text_col]]
    own = docs.select(*order)
    out = own.mapInArrow(tx.tidy(_redact(fit(docs, text_col=text_col) if weights is None else weights)), own.schema)
    return out.select(*docs.columns)
