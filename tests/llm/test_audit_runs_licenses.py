"""Filter audit, periodic runs and license scan next to brute force, on small, awkward and random inputs."""

import itertools
import random
import re

import numpy as np
import pytest

from pulsegrid.llm import filter_audit, license_rules, licenses, periodic
from pulsegrid.llm.queries import QUERIES, with_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- filter audit ----

def brute_audit(rows, labels):
    """The counts by walking every order over every document."""
    text = [t or "" for _, t, _ in rows]
    failing = []
    for (doc, _, _), t in zip(rows, text, strict=True):
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": doc is not None and any(d is not None and d < doc and u == t for (d, _, _), u in zip(rows, text, strict=True))}
        failing.append({k for k, v in fails.items() if v})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, shapley = {}, {}
    for part in {p or "" for _, _, p in rows}:
        some = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            alive = set(some)
            for step, letter in enumerate(order, 1):
                fails = {k for k in some if letter in failing[k]}
                gone = fails & alive
                redundant = fails - alive
                alive -= gone
                out[part, "".join(order), step] = [len(alive), len(gone), len(redundant), sum(failing[k] == {letter} for k in some),
                                                   sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(docs, labels):
    rows = collected(filter_audit.audit(docs, labels))
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in [*filter_audit.COUNTS, "shapley"]] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        n = rng.choice([0, 3, 250, 250])
        w = [rng.choice(["Alpha", "beta", "GAMMA", "x#y", "é", "delta"]) if rng.random() < 0.1 else f"w{rng.randrange(rng.choice([20, 4000]))}" for _ in range(n)]
        rows.append((rng.choice([None, k, k, k, k]), " ".join(w), rng.choice(["en", "de", None, ""])))
    rows += [(1000 + k, rows[k % 7][1], "en") for k in range(30)] + [(7, rows[7][1], "de"), (2000, None, None), (2001, None, "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 1030, 3)] + [(None, 1, 1), (3, 1, 1), (999_999, 1, 1)]
    got = audited(spark.createDataFrame(rows, "doc_id long, text string, lang string"),
                  spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == brute_audit(rows, labels)


def test_audit_of_awkward_documents(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    got = audited(documents, labels)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in collected(documents)]
    assert got == brute_audit(rows, [(1, 1, 1)])
    assert audited(nothing, labels) == {}
    assert audited(documents, labels.where("1 = 0")) == brute_audit(rows, [])


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = collected(filter_audit.audit(docs, labels, filters={"Q": lambda text, words: text == "b"}, duplicates="Z"))
    assert {(r["filter_order"], r["step"], r["kept"], r["removed"], r["shapley"]) for r in got} == {
        ("QZ", 1, 2, 1, 2), ("QZ", 2, 1, 1, 2), ("ZQ", 1, 2, 1, 2), ("ZQ", 2, 1, 1, 2)}


# ---- periodic runs ----

def brute_runs(w, least=periodic.LEAST):
    """All stretches with equal words q apart, q from small to large; those inside one of a period that divides q are not smallest."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 3 * q) and not any(q % p == 0 and s <= i and i + length <= s + m for s, m, p in out):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_words(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        block = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 40))]
        n = rng.randrange(1, 5) * len(block) + rng.randrange(len(block) + 1)
        w += [block[k % len(block)] for k in range(n)] if rng.random() < 0.7 else block
    return w


@pytest.mark.parametrize(("seed", "least"), [(seed, least) for seed in range(12) for least in (24, 3)])
def test_runs_against_brute_force(seed, least):
    rng = random.Random(seed)
    texts = [periodic_words(rng) for _ in range(150)] + [[], ["a"], ["a"] * 200, ["a", "b"] * 90, list("aab" * 30), list("abaab" * 20)]
    keys = np.concatenate([np.array([hash((k, x)) for x in w], np.int64) for k, w in enumerate(texts)])
    ends = np.cumsum([len(w) for w in texts])
    start, length, period = periodic.repetitions(keys, np.repeat(ends, [len(w) for w in texts]), least)
    of = np.searchsorted(ends, start, "right")
    got = {}
    for k, s, n, q in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got.setdefault(k, []).append((s - int(ends[k]) + len(texts[k]), n, q))
    assert got == {k: r for k, w in enumerate(texts) if (r := brute_runs(w, least))}


def test_collapsed_texts_and_null_ids(spark, monkeypatch):
    from pulsegrid.llm import text as tx

    rng = random.Random(9)
    texts = ["  \t".join(periodic_words(rng)) for _ in range(40)] + [None, "", " \n ", "é è " * 40, "A a " * 30]
    rows = [(None if k % 9 == 4 else k % 30, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = []
    for doc, t in rows:
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        want.append((doc, len(w), runs, collapsed(w, runs)))
    for limit in (1_000_000, 100):
        monkeypatch.setattr(tx.slices, "__defaults__", (limit,))
        got = [(r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["text"]) for r in collected(periodic.collapse(docs))]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_runs_of_awkward_documents(documents, nothing):
    got = {(r["doc_id"], r["text"]): r for r in collected(periodic.collapse(documents))}
    assert got[2, ""]["runs"] == got[4, ""]["runs"] == [] and got[2, ""]["n_words"] == 0
    assert periodic.collapse(documents).count() == documents.count()
    assert periodic.collapse(nothing).count() == 0


def test_repeated_words_of_documents(spark):
    import zlib

    rows = [(k, " ".join(f"w{k}x{i}" for i in range(k % 50))) for k in range(-5, 300)] + [(None, "one two"), (60, None)]
    got = {(r["doc_id"], k): r["text"] for k, r in enumerate(collected(with_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))))}
    for k, (doc, t) in enumerate(rows):
        w, h = (t or "").split(), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            t = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
        assert got[doc, k] == t


# ---- license scan ----

UPPER = {c: c + 32 for c in range(65, 91)}
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    w = LICENSE_WORD.findall((text or "").translate(UPPER))
    found = [(label, i, len(p.split())) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), sorted(found, key=lambda p: (p[1], p[0]))


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", {"apache-2.0"}),
    ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", {"lgpl"}),
    ("Released under the MIT License.", {"mit"}),
    ("This work is licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
    ("Creative Commons Attribution 3.0 Unported", {"cc-by-3.0"}),
    ("Copyright (c) 2019 A. Person. All rights reserved.", {"copyright", "reserved"}),
    ("Alle Rechte vorbehalten. Tous droits réservés.", {"reserved"}),
    ("GPLv2 or the Mozilla Public License 2.0", {"gpl-2.0", "mpl-2.0"}),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", {"bsd"}),
    ("mit freundlichen Grüßen, general notes on public affairs; ein bsl ist kein mpl", set()),
    ("", set()), (None, set())])
def test_rules_on_notices(text, labels):
    n, _, found, score = licenses.Scanner(license_rules.rules(), licenses.PHRASES)(text or "")
    assert {d[1] for d in found} == labels and n == places(text)[0]
    assert (score > 0) == bool(labels)


def test_every_rule_matches_only_with_a_literal():
    """The prefilter may not hide a match: of all phrases that rules name, those matched hold one of the rule's literals."""
    all_rules = license_rules.rules()
    assert len(all_rules) > 300 and len({r.name for r in all_rules}) == len(all_rules)
    names = [r.label.replace("-", " ").replace(".", " ") for r in all_rules]
    text = " . ".join([f"{form} {name}{tail}" for name in set(names) for form in ("licensed under the", "spdx license identifier", "see")
                       for tail in ("", " license", " license version 2 0")])
    text += " gnu lesser general public license mit lizenz unter mit sous licence mit bajo licencia mit cc attribution share alike 4 0 license version 3"
    data, _ = licenses.normal(text)
    for r in all_rules:
        for m in re.finditer(b"(?<= )(?:%s)(?= )" % r.pattern.encode(), data):
            assert any(x.encode() in b" " + m.group() + b" " for x in r.literals), (r.name, m.group())


def test_suppression_against_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 25)
        start = np.array([rng.randrange(20) for _ in range(n)])
        end = start + [rng.randrange(1, 8) for _ in range(n)]
        level, rank = np.array([rng.randrange(3) for _ in range(n)]), np.array(rng.sample(range(100), n))
        kept = []
        for i in sorted(range(n), key=lambda i: (level[i], start[i] - end[i], rank[i])):
            if not any(start[k] <= start[i] and end[i] <= end[k] for k in kept):
                kept.append(i)
        assert sorted(licenses.resolved(start, end, level, rank).tolist()) == sorted(kept)


def test_places_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved", "All rights reserved.", "é", "x9", "\x7f", "\n", "GNU", "v3"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(200)] + [(None, "cc by cc by"), (1, None)]
    got = collected(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    for (doc, t), r in zip(rows, got, strict=True):
        assert (doc, *places(t)) == (r["doc_id"], r["n_words"], [(p["label"], p["start"], p["length"]) for p in r["places"]])
        assert 0 <= r["score"] <= 1 and (r["score"] > 0 or not r["places"])


def test_licenses_of_awkward_documents(documents, nothing):
    assert licenses.scan(documents).count() == documents.count()
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_license_scan"])
def test_queries_return_their_columns(spark, tmp_path, documents, name):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    want = {"op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            "op13_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]}[name]
    assert out.columns == want and out.count() == documents.count()
    assert all(r["runs_sha256"] and r["collapsed_sha256"] for r in collected(out)) if name.startswith("op12") else out.where("labels IS NULL").isEmpty()
