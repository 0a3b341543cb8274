"""The ten operators next to brute force, on small, awkward and random inputs."""

import base64
import collections
import fractions
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import components, fingerprints, jaccard, language_model, mixing, packing, pii, quality, urls, vectors, warc
from pulsegrid.llm import text as tx
from pulsegrid.llm.queries import RULES, vocabulary
from pulsegrid.session import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def collected(df):
    return [r.asDict() for r in df.collect()]


def roots(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- shared parts ----

def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(4000, 4040)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")
    want = roots(edges, {x for e in edges for x in e} | {7})
    assert {r["node"]: r["component"] for r in collected(components.components(df))} == want
    assert components.components(df.where("1 = 0")).count() == 0


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    from pulsegrid.llm import text as tx

    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé \t\n,") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 5000]
    known = {}
    for i, j, w in tx.batches_of_words(pa.array(texts)):
        for k in range(i, j):
            got = w.hashes[w.bounds[k - i]:w.bounds[k - i + 1]].tolist()
            want = words(texts[k])
            assert len(got) == len(want)
            for h, x in zip(got, want, strict=True):
                assert known.setdefault(h, x) == x
    assert len(set(known.values())) == len(known)


# ---- 1 ----

def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_join(rows, join):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t, join.words))
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] for x in sets[a] for y in sets[b]
             if x and y and join.linked(len(x & y), len(x | y))]
    return roots(links, ids)


def related(rng, n, size):
    """Texts with families: copies with a few words changed, of all degrees."""
    out = []
    for i in range(n):
        if i and rng.random() < 0.7:
            w = list(rng.choice(out[-12:]))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        else:
            w = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([3, size, size, 2 * size]))]
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("join", "leaf", "seed"), [(jaccard.Join(3, 90, 100), 48, 1), (jaccard.Join(1, 80, 100), 3, 2), (jaccard.Join(2, 70, 100), 2, 3)])
def test_jaccard_join_loses_no_link(spark, monkeypatch, join, leaf, seed):
    monkeypatch.setattr(jaccard, "OUTSIDERS", leaf - 2)
    monkeypatch.setattr(jaccard, "SHARD", 6000)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "BLOCK", leaf)
    rows = related(random.Random(seed), 150, 60)
    got = collected(jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), join))
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_join(rows, join)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(shingles(t, join.words)) for d, t in rows}


def passages(rng, n):
    """Texts with a passage that many share, and much or little besides: alike, nearly alike and far from it."""
    shared = [f"p{k}" for k in range(80)]
    return [(i, " ".join(shared[:rng.choice([40, 60, 80])] + [f"x{i}y{k}" if rng.random() < 0.7 else f"z{k}" for k in range(rng.choice([4, 8, 16, 30, 90]))])) for i in range(n)]


@pytest.mark.parametrize(("outsiders", "block", "largest"), [(32, 512, 0.75), (0, 512, 0.75), (0, 7, 0.0), (3, 7, 1.0)])
def test_jaccard_join_of_shared_passages(spark, monkeypatch, outsiders, block, largest):
    monkeypatch.setattr(jaccard, "OUTSIDERS", outsiders)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LARGEST", largest)
    monkeypatch.setattr(jaccard, "COPIES", 1.5 if largest < 1 else 8)
    monkeypatch.setattr(jaccard, "SHARD", 9000)
    monkeypatch.setattr(jaccard, "ENTRIES", 900)
    join, rows = jaccard.Join(5, 80, 100), passages(random.Random(11), 130)
    got = collected(jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), join))
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_join(rows, join)


def test_rarest_shingles_meet_for_every_similar_pair(spark):
    join, rows = jaccard.Join(2, 80, 100), related(random.Random(6), 160, 40) + [(200 + k, t) for k, t in passages(random.Random(7), 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    regions = collected(jaccard._lists(docs, docs.select("doc_id"), join))
    of = collections.defaultdict(set)
    for r in regions:
        of[r["region"]].add(r["doc"])
    met = {(a, b) for some in of.values() for a in some for b in some}
    sets = {d: shingles(t, join.words) for d, t in rows}
    similar = [(a, b) for a in sets for b in sets if a < b and sets[a] and join.linked(len(sets[a] & sets[b]), len(sets[a] | sets[b]))]
    assert len(similar) > 50 and met.issuperset(similar)


def test_jaccard_join_moves_only_texts_that_are_asked_for(spark):
    """The documents meet the bit map before the join by id, also where the ids are too many to be broadcast."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)] + [(None, "nameless"), (7, "again")], "doc_id long, text string")
    ids = docs.where("doc_id % 20 = 7").select("doc_id").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard.texts_of(docs, ids)
        joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert sorted(map(tuple, found.collect())) == [(7, "again"), (7, "text 7"), (27, "text 27"), (47, "text 47")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "word" in joins[1] and "doc_id" in joins[0] and "word" not in joins[0]


def test_a_shard_is_sent_in_small_batches():
    """The JVM holds a batch as a whole outside its heap, and keeps room for it."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 300)) for _ in range(1500)]
    texts += [t + " end" for t in texts[:40]] + texts[:3]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    join = jaccard.Join(5, 80, 100)
    sent = list(jaccard._code(join, jaccard.BUCKETS)(iter([batch])))
    assert max(b.nbytes for b in sent) < 2_000_000 < sum(b.nbytes for b in sent)
    rows = [r for b in sent for r in b.to_pylist()]
    assert sorted(d["doc_id"] for r in rows for d in r["docs"] or []) == list(range(len(texts)))
    holders = collections.defaultdict(set)
    for d, s in enumerate(s for _, _, w in tx.batches_of_words(batch.column(1)) for s in jaccard.shingle_sets(w, 5)):
        for key in jaccard.Slicer(join).keys(s).tolist():
            holders[key].add(d if d < 1540 else d - 1540)  # exact copies are the first of them
    keys = [(r["bucket"], k) for r in rows if r["keys"] for k in np.frombuffer(r["keys"], np.uint64).tolist()]
    assert sorted(k for _, k in keys) == sorted(holders) and all((k >> 48) % jaccard.BUCKETS == b for b, k in keys)
    regions = {(r["region"] & (1 << 64) - 1, r["doc"]) for r in rows if r["region"] is not None}
    assert regions == {(k, d) for k, some in holders.items() if len(some) > 1 for d in some}


def test_workers_give_unused_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(tx, "release", lambda: done.append(1))
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a b c d", "a b c d e"])], ["doc_id", "text"])
    sent = list(jaccard._code(jaccard.Join(), 16)(iter([batch])))
    assert sent and len(done) == len(sent) + 1


def test_jaccard_join_of_awkward_documents(documents, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = collected(jaccard.link_components(documents))
    want = brute_join(rows, jaccard.Join())
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, want.get(d)) for d, _ in rows}
    assert jaccard.link_components(nothing).count() == 0


def test_slices_meet_for_every_similar_pair():
    rng = np.random.default_rng(4)
    join = jaccard.Join(3, 90, 100)
    slicer = jaccard.Slicer(join)
    for _ in range(400):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = a[rng.random(len(a)) > rng.choice([0, 0.03, 0.09])]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 15))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if join.linked(both, len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(slicer.keys(a), slicer.keys(b)))


# ---- 2 ----

@pytest.mark.parametrize(("cell", "block"), [(4096, 16384), (60, 50)])
def test_vectors_against_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((240, 24))
    for i in range(60, 240):
        if rng.random() < 0.6:
            x[i] = x[rng.integers(0, i)] + rng.standard_normal(24) * rng.choice([0, 0.15, 0.35, 0.5])
    x[200:230] = x[5] + 0.02 * rng.standard_normal((30, 24))
    x[230:] = x[6]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [None] * 24), (1003, [float("nan")] * 24), (1004, []), (1005, [1.0, 0.0]), (1006, [1.0, 0.0]), (None, rows[0][1])]
    got = {r["vec_id"]: r for r in collected(vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")))}
    unit = np.array([v for _, v in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    links = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    found = sum(got[i]["n_links"] for i in range(240))
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(240))
    assert found >= 0.99 * 2 * len(links)
    if found == 2 * len(links):
        want = roots(links, range(240))
        assert all(got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in range(240))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (1000, 1001, 1002, 1003, 1004))
    assert got[1006]["component_id"] == 1005 and got[1005]["n_links"] == 1


@pytest.mark.parametrize("levels", [1, 3, 6, 12])
def test_pairs_at_the_threshold_are_found_at_any_number_of_levels(spark, monkeypatch, levels):
    n, dim, rng = 1000, 32, np.random.default_rng(levels)
    cell = 2 * n * vectors._together(math.sqrt(2)) ** (levels - 0.5)
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "GROUP", 3000)
    assert vectors.plan(2 * n).levels == levels
    a = vectors.unit_vectors(rng.standard_normal((n, dim)))
    away = rng.standard_normal((n, dim))
    away = vectors.unit_vectors(away - (away * a).sum(axis=1, keepdims=True) * a)
    cosine = rng.uniform(0.9, 0.93, (n, 1))
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine ** 2) * away])
    unit = vectors.unit_vectors(x)
    true = (unit @ unit.T >= 0.9).sum() - 2 * n
    got = collected(vectors.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")))
    assert true > 1900 and 0.99 * true <= sum(r["n_links"] for r in got) <= true


def test_very_large_and_very_small_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e200, 2e200]), (2, [1e-200, 0.0]), (3, [5e-324, 0.0]), (4, [1.7e308, -1.7e308]), (5, [1.0, -1.0]), (6, [math.inf, 1.0])]
    got = {r["vec_id"]: r for r in collected(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    assert [got[i]["component_id"] for i in range(7)] == [0, 0, 2, 2, 4, 4, 6] and [got[i]["n_links"] for i in range(7)] == [1] * 6 + [0]


def test_copies_of_a_vector_grow_slowly():
    copies = [vectors.plan(n).tables for n in (50_000, 5_000_000, 500_000_000)]
    assert copies[1] <= copies[0] * 100 ** 0.32 and copies[2] <= copies[1] * 100 ** 0.32


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# ---- 3 ----

def test_archives_round_trip(spark):
    big = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né" * 60
    rows = [(1, "http://a/1", big), (2, "http://a/2", None), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"),
            (9, "http://a/9\r\nX: y", big), (8, "http://a/8", big + "!"), (9, "http://a/9", "other" * 300), (-3, "u", "other" * 300), (12, "", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted(collected(warc.deduplicate(pages, scratch(spark, "warc"))), key=lambda r: (r["page_id"], r["payload_digest"]))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "") == (h or ""))
        revisit = len(data) >= 1000 and top != i
        want.append({"page_id": i, "payload_bytes": len(data), "payload_digest": hashlib.sha1(data).hexdigest(),
                     "record_type": "revisit" if revisit else "response", "refers_to": top if revisit else None, "digest_ok": True})
    assert got == sorted(want, key=lambda r: (r["page_id"], r["payload_digest"]))
    assert warc.deduplicate(pages.where("1 = 0"), scratch(spark, "warc")).count() == 0


def test_archives_of_null_and_repeated_ids(spark):
    big, alone = "b" * 1200, "c" * 1200
    rows = [(None, "u", big), (7, "u", big), (7, "u", big), (5, "v", big), (None, "w", alone), (None, None, alone), (None, "x", "small"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collected(warc.deduplicate(pages, scratch(spark, "warc")))
    assert all(r["digest_ok"] for r in got)
    assert (collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
            == {(7, 1200, "response", None): 2, (None, 1200, "revisit", 7): 1, (5, 1200, "revisit", 7): 1,
                (None, 1200, "response", None): 2, (None, 5, "response", None): 1, (None, 0, "response", None): 1})


# ---- 4 ----

def test_classifier_orders_grades(spark):
    rng = random.Random(2)
    plain = [f"p{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(1800):
        kind = i % 3
        w = [rng.choice(plain) for _ in range(60)]
        if kind == 0:
            w[rng.randrange(60)] = w[rng.randrange(60)] = rng.choice(["vile", "nasty", "foul"])
        if kind == 1:
            w = [rng.choice(plain[:3]) for _ in range(60)]
        rows.append((i, " ".join(w)))
        if i < 1500:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    graded = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, graded)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in collected(quality.rate(docs, model))}
    held = range(1500, 1800)
    assert np.mean([got[i]["keep"] == (i % 3 == 2) for i in held]) > 0.95
    mean = [np.mean([got[i]["expected_grade"] for i in held if i % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert {r["doc_id"] for r in collected(quality.selected(docs, model))} == {i for i in got if got[i]["keep"]}


def test_classifier_of_awkward_documents(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(documents, labels)
    got = quality.rate(documents, model).collect()
    assert len(got) == documents.count() and all(0 <= r["tail_probability"] <= 1 for r in got)
    same = [r["tail_probability"] for r in got if r["doc_id"] in (1, 7, 12)]
    assert len(set(same)) == 1
    assert quality.selected(documents, model).columns == documents.columns
    none = quality.fit(documents, labels.where("1 = 0"))
    assert all(r["keep"] for r in quality.rate(documents, none).collect())
    assert quality.rate(nothing, model).count() == 0


# ---- 5 ----

def test_packing_round_trip(spark, monkeypatch, documents, nothing):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK", 3)
    tokenizer = Tokenizer.from_file(vocabulary())
    extra = [(100, "it's <|startoftext|> A<|endoftext|>b <|ENDOFTEXT|>"), (101, "Don't stop.we'll é שׁ Å x,y;z 12.5%,# 日本 .'s"), (102, "a.b" * 50)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = collected(packing.pack_documents(docs, vocabulary(), window=512, group=20))
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    for d, some in texts.items():
        want = []
        for t in some:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes()), len(ids)) for s in range(0, len(ids), 512)]
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[d]) == sorted(want)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in by_sequence.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(nothing, vocabulary()).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(6)
    lengths = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    tree, plain = packing.OpenWindows(100), []
    for n in lengths:
        at, used = tree.place(n)
        fitting = [(100 - u, k) for k, u in enumerate(plain) if 100 - u >= n]
        if fitting:
            assert 100 - plain[at] == min(fitting)[0] and used == plain[at]
            plain[at] += n
        else:
            assert (at, used) == (len(plain), 0)
            plain.append(n)


# ---- 6 ----

def test_blocks_reach_aliases(spark):
    def page(i, url, html=None):
        return (i, url, html, "x")

    link = '<link href="{}" rel=canonical>'
    rows = [page(1, "https://a.org/x", '<meta http-equiv="refresh" content="0; url=https://b.org/y">'), page(2, "https://b.org/y", link.format("http://Z.net/es/1")),
            page(3, "http://c.org/", link.format("/home")), page(4, "http://c.org/home#x"), page(5, "http://q.example.com/en/1"),
            page(6, "http://www.example.com/en/1"), page(7, "http://t.com/", link.format("https://b.org/y")), page(8, None), page(9, "nowhere"), page(10, "ftp://com/de"),
            page(11, "https://a.org/x?utm_source=feed"), page(12, "http://com"), page(13, "http://xnet/es/"), page(14, "http://A.NET/fr/b?x#y"), page(14, "http://A.NET/fr/b?x#y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in collected(urls.judge(pages, urls.rules(spark, RULES)))}
    assert {k: r["verdict"] for k, r in got.items() if r["verdict"] == "block"}.keys() == {1, 2, 5, 11, 14}
    assert (got[7]["rule"], got[7]["verdict"]) == ("com/", "allow")  # its own rule goes before the blocked alias
    assert (got[6]["rule"], got[5]["rule"], got[12]["rule"], got[13]["rule"]) == ("www.example.com/en/", "example.com/en/", None, None)
    assert (got[14]["host"], got[14]["path"]) == ("a.net", "/fr/b")
    assert all((got[k]["host"], got[k]["path"], got[k]["rule"]) == ("", "", None) for k in (8, 9))
    assert urls.judge(pages, urls.rules(spark, RULES)).count() == len(rows)
    assert urls.judge(pages.where("1 = 0"), urls.rules(spark, RULES)).count() == 0
    assert {r["verdict"] for r in collected(urls.judge(pages, urls.rules(spark, [])))} == {"allow"}


def test_aliases_by_normal_forms_and_relative_links(spark):
    forms = {"http://h.org/a?utm_source=f#top": "https://h.org/a", "http://h.org/a?utm_source=f&utm_medium=m": "https://h.org/a",
             "https://h.org/a?id=3&utm_source=f&gclid=1&x=4": "https://h.org/a?id=3&x=4", "https://h.org/a?fbclid=1&id=3": "https://h.org/a?id=3",
             "https://h.org/a?#t": "https://h.org/a?", "https://h.org/a?id=&&x": "https://h.org/a?id=&&x", "http://h.org/a#b?utm_source=f": "https://h.org/a",
             "http://h.org/a&utm_source=f": "https://h.org/a&utm_source=f"}
    links = {("page.html", "http://h.org/d/a?q#f"): "http://h.org/d/page.html", ("../x?y=../z", "http://h.org/d/e/a"): "http://h.org/d/x?y=../z",
             ("./", "http://h.org/d/a"): "http://h.org/d/", ("..", "http://h.org/d/a/b"): "http://h.org/d/", ("../../..", "http://h.org/d/a"): "http://h.org/",
             ("p", "http://h.org"): "http://h.org/p", ("?q", "http://h.org/d/a?x"): "http://h.org/d/a?q", ("#q", "http://h.org/d/a?x#y"): "http://h.org/d/a?x#q",
             ("/go?to=http://x.org/", "http://h.org/d"): "http://h.org/go?to=http://x.org/", ("go?to=http://x.org/", "http://h.org/d/"): "http://h.org/d/go?to=http://x.org/",
             ("//x.org/a", "http://h.org/d"): "http://x.org/a", ("https://x.org", "http://h.org/d"): "https://x.org", ("mailto:a@b.org", "http://h.org/d"): None, ("", "http://h.org/d"): None}
    got = spark.createDataFrame(list(forms), "string").select("value", urls.normal_form(F.col("value")).alias("n"))
    assert {r["value"]: r["n"] for r in got.collect()} == forms
    got = spark.createDataFrame(list(links), "t string, u string").select("t", "u", urls.resolved(F.col("t"), F.col("u")).alias("r"))
    assert {(r["t"], r["u"]): r["r"] for r in got.collect()} == links
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://b.net/es/1", link.format("https://m.org/1")), (2, "http://m.org/1?utm_source=f&utm_medium=m#t", None),
            (3, "http://n.org/d/a", link.format("http://m.org/1#z")), (4, "https://o.org/d/b.html", None), (5, "http://b.net/es/2", link.format("http://o.org/d/b.html#q")),
            (6, "https://p.org/d/c", link.format("e")), (7, "https://p.org/d/e?gclid=4#x", link.format("http://b.net/fr/")), (8, "http://m.org/1t", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"] for r in collected(urls.judge(pages, urls.rules(spark, RULES))) if r["verdict"] == "block"} == set(range(1, 8))


def test_links_that_are_aliases(spark):
    bad = "http://b.net/es/p"
    htmls = [f'<meta http-equiv=refresh content="600; url={bad}">', f'<!-- <link rel="canonical" href="{bad}"> -->', f'<!-- open <link rel=canonical href={bad}>',
             f'<link rel="notcanonical" href="{bad}">', f'<link href="{bad}" rel="stylesheet">', f'<p>rel=canonical href={bad}</p>',  # up to here none is an alias
             f'<META content="0.0;URL={bad}" http-equiv="Refresh">', f'<link rel="alternate\ncanonical" href="{bad}">',
             f'<link rel=canonical href="https://else.org/"><link rel=\'canonical\' href=\'{bad}\'/>', f'<!-- a --><link\nrel=canonical href={bad}>']
    rows = [(k, f"https://s{k}.org/x", h) for k, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"] for r in collected(urls.judge(pages, urls.rules(spark, RULES))) if r["verdict"] == "block"} == {6, 7, 8, 9}


# ---- 7 ----

PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            twice = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                yield kind, m.start(), m.end()


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..  --++@@ab%()") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == list(plain_spans(text))
    assert pii.base_spans("1" * 200_000 + "-" * 50_000 + "a" * 200_000) == []
    zeros = "0" * 9000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}255") == [("ip", 0, 18009)] and pii.base_spans(f"{zeros}1.2.3.{zeros}256") == []


def pii_samples():
    rng = random.Random(9)
    out = []
    for k in range(40):
        around = [" ".join(rng.choice(["thon", "erat", "und", "la", "der"]) for _ in range(9)) + " " for _ in range(2)]
        card = [rng.randrange(10) for _ in range(15)]
        card = "".join(map(str, card)) + next(str(d) for d in range(10) if pii.luhn("".join(map(str, card)) + str(d)))
        for kind, s in (("email", f"ab{k}.c@mail{k % 7}.example.com"), ("ip", ".".join(str(rng.randrange(256)) for _ in range(4))),
                        ("card", card), ("phone", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}")):
            out.append((kind, s, around[0], " " + around[1]))
    return out


def test_field_finds_other_formats_and_no_more():
    samples = pii_samples()
    weights = pii.train(samples[:100])
    right = 0
    cases = [(before, surface, after, label) for turn, (kind, s, before, after) in enumerate(samples[100:]) for surface, label in pii.variants(kind, s, turn)]
    for before, surface, after, label in cases:
        base, every = pii.find(before + surface + after, weights)
        assert set(base) <= set(every)
        added = set(every) - set(base)
        right += (label in {k for k, a, b in added if (a, b) == (len(before), len(before) + len(surface))}) if label else not every
    assert right / len(cases) > 0.95
    assert pii.find("thon erat 12 und 2024-01-02, 99.5% of 1000 la der. At dot then", weights)[1] == []


def test_spelled_out_addresses_in_texts_without_digits_or_brackets(spark):
    weights = pii.train(pii_samples()[:100])
    cases = ["anna.b at example.com", "ANNA.B AT EXAMPLE DOT COM", "anna.b at mail\tdot\tcom", "anna.b@example.com"]
    texts = [f"thon erat {c} und la" for c in cases]
    docs = spark.createDataFrame([*enumerate(texts), (9, "Look at the end. Then"), (10, "nothing"), (11, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in collected(pii.detect(docs, weights))}
    assert [got[k] for k in range(4)] == [f"email:10:{10 + len(c)}" for c in cases]
    assert got[9] == got[10] == got[11] == ""
    clean = {r["doc_id"]: r["text"] for r in collected(pii.redacted(docs, weights))}
    assert all(clean[k] == "thon erat <EMAIL> und la" for k in range(4)) and clean[9] == "Look at the end. Then"
    rng = random.Random(4)  # a text that is passed over holds no proposal and no base span
    for _ in range(3000):
        text = "".join(rng.choice(["at", "AT", "dot", " ", ".", "@", "[", "]", "é", "x", "1", "(", ")", "-"]) for _ in range(12))
        if next(pii._texts(pa.array([text]))) is None:
            assert not pii.base_spans(text) and not any(s.search(text) for s in pii.SHAPES)


def test_dynamic_program_beats_all_segmentations():
    weights = np.random.default_rng(3).standard_normal((4, pii.WIDTH))
    text = "tel (212) 555-0100 212-555-0101 and 10[.]0[.]0[.]1 x"
    x = pii.Lattice(text)
    score = pii._scores(x, weights) - pii.MARGIN

    def totals(at, k):
        yield 0.0
        for n in range(k, len(x.segments)):
            if x.segments[n][0] >= at:
                for rest in totals(x.segments[n][1], n + 1):
                    yield score[n].max() + rest

    order = sorted(range(len(x.segments)), key=lambda k: x.segments[k][:2])
    x.segments, score = [x.segments[k] for k in order], score[order]
    x.features = x.features[order]
    found = {(a, b, k) for k, a, b in pii.best(x, weights)}
    value = sum(score[n, pii.KINDS.index(k)] for n, (_, _, a, b) in enumerate(x.segments) for k in pii.KINDS if (a, b, k) in found)
    assert value == pytest.approx(max(totals(0, 0)))
    z, p = pii.expected(x, weights)
    step = 1e-5
    weights[2, 0] += step
    assert (pii.expected(x, weights)[0] - z) / step == pytest.approx((p[:, 2] * x.features[:, 0]).sum(), abs=1e-3)


def test_personal_data_of_awkward_documents(documents, nothing):
    weights = pii.train(pii_samples()[:60])
    got = collected(pii.detect(documents, weights))
    texts = collections.Counter((r["doc_id"], ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(r["text"] or ""))) for r in documents.collect())
    assert collections.Counter((r["doc_id"], r["spans"]) for r in got) == texts
    row = next(r for r in got if r["doc_id"] == 14)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    clean = pii.redacted(documents, weights)
    assert clean.columns == documents.columns
    text = next(r["text"] for r in clean.collect() if r["doc_id"] == 14)
    assert text == "mail <EMAIL> or <IP>, card <CARD>, <PHONE>"
    assert pii.detect(nothing).count() == 0


# ---- 8 ----

@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1e-9, "c": 3}, {"a": 0.61, "b": 0.39, "c": 0}])
def test_mixing_deviates_by_less_than_a_block(spark, weights):
    counts = {"a": 700, "b": 400, "c": 155, "d": 33}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))] + [(5000, None)]
    got = collected(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4, slots=100))
    assert sorted(r["position"] for r in got) == list(range(len(rows))) and {r["doc_id"] for r in got} == {d for d, _ in rows}
    got.sort(key=lambda r: r["position"])
    for phase in sorted({r["phase"] for r in got}):
        order = list(dict.fromkeys((r["slot"], r["source"]) for r in got if r["phase"] == phase))
        active = {s: weights.get(s, 0) for s in {s for _, s in order} | {s for s, _ in ((r["source"], 0) for r in got if r["phase"] > phase)}}
        share = mixing.shares({s or "": w for s, w in active.items() if w > 0} or dict.fromkeys((s or "" for s in active), 1), 100)
        done = collections.Counter()
        for t, (_, s) in enumerate(order, 1):
            done[s or ""] += 1
            assert all(abs(done[n] - t * k / sum(share.values())) < 1 for n, k in share.items())


def test_mixing_follows_the_weights_as_given_over_many_periods(spark):
    weights = {f"s{k}": w for k, w in enumerate([0.13958, 0.04528, 1e-9, 1 / 3, *[0.0123 + k / 7919 for k in range(16)]])}
    total = sum(map(fractions.Fraction, weights.values()))
    done = collections.Counter()
    for t, (phase, slot, n, b) in enumerate(mixing.schedule(dict.fromkeys(weights, 100_000), weights), 1):
        assert (phase, slot, b) == (0, t - 1, done[n])
        done[n] += 1
        if t % 97 == 0:
            assert all(abs(done[n] * total - t * fractions.Fraction(w)) < total for n, w in weights.items())
        if t == 60_000:
            break
    rows = [(i, f"s{min(i % 60, 20)}") for i in range(60_000)]  # s20 has two thirds
    given = mixing.tempered(collections.Counter(s for _, s in rows))
    given["s20"] *= 1.0007
    got = collected(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), given, block=2, slots=50))
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    order = sorted({(r["slot"], r["source"]) for r in got if r["phase"] == 0})
    done.clear()
    for t, (_, n) in enumerate(order, 1):
        done[n] += 1
        assert all(abs(done[n] - t * w / sum(given.values())) < 1 + 1e-9 for n, w in given.items())
    assert len(order) > 3000


def test_mixing_of_awkward_documents(documents, nothing):
    got = mixing.mix(documents).collect()
    assert sorted(r["position"] for r in got) == list(range(documents.count()))
    assert mixing.mix(nothing).count() == 0


# ---- 9 ----

def test_sketches_against_sets(spark, monkeypatch, documents, nothing):
    monkeypatch.setattr(fingerprints, "RANGE", 5)
    got = sorted(collected(fingerprints.fingerprint(documents)), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        a, b, c = (set(fingerprints.digests([x])[0].tolist()) for x in (t, edited, following))
        some = [r for r in got if r["doc_id"] == d]
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *(len(a & o) / len(a | o) if a | o else 1.0 for o in (b, c)))
        assert any((r["n_chars"], r["edited_sha256"]) == want[:2] and (r["near_edited"], r["near_next"]) == pytest.approx(want[2:]) for r in some)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 7, 12)}) == 1
    assert fingerprints.fingerprint(nothing).count() == 0


def test_written_counts_are_whole():
    n = 600_000  # about 75,000 to a cell
    (written,) = fingerprints.fingerprints((np.arange(n, dtype=np.uint64), np.array([0, n])))
    cells = np.frombuffer(base64.b64decode(written.split(":")[1]), np.dtype([("count", "<u4"), ("sum", "<u8"), ("check", "<u4")]))
    assert len(cells) == fingerprints.CELLS and cells["count"].sum() == fingerprints.HASHES * n and cells["count"].max() > 65_535


def test_nameless_pieces_are_dealt_to_all_groups(spark):
    cut = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"),
                                   F.lit(7).cast("long").alias("ids_crc32"), F.lit(700).cast("long").alias("doc_tokens"))
    got = collections.Counter(r["sequence_id"] >> 36 for r in packing.pack(cut, group=500).collect())
    assert len(got) == 4 and sum(got.values()) == 2000 and max(got.values()) < 700


def test_peeling_recovers_the_differing_digests():
    rng = np.random.default_rng(2)
    digest = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    sign, owner = np.where(np.arange(len(digest)) % 3 == 0, -1, 1), np.zeros(len(digest), np.int64)
    done, held, (_, found) = fingerprints.peel(fingerprints.sketches(digest, owner, sign, 1, 900), 1, 900, 500)
    assert done.all() and held[0] == len(digest) and set(found.tolist()) == set(digest.tolist())
    done, *_ = fingerprints.peel(fingerprints.sketches(digest, owner, sign, 1, 30), 1, 30, 500)
    assert not done.any()


# ---- 10 ----

def brute_model(rows):
    texts = [(d, words(t) + [None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    c, b = collections.Counter(), collections.Counter()
    for (_, w), out in zip(texts, held, strict=True):
        if not out:
            c.update(w)
            b.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    types, some = collections.Counter(x for x, _ in b), collections.Counter(b.values())
    discount = some[1] / (some[1] + 2 * some[2]) if some[1] and some[2] else 0.5

    def p(x, w):
        one = (c[w] + 1) / (n + v + 1)
        return (max(b[x, w] - discount, 0) + discount * types[x] * one) / c[x] if c[x] else one

    return [(d, out, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w),
             sum(math.log10(p(x, y)) for x, y in zip([None, *w[:-1]], w, strict=True))) for (d, w), out in zip(texts, held, strict=True)], p, c


@pytest.mark.parametrize(("shard", "entries"), [(10_000_000, 1_500_000), (4000, 300)])
def test_scores_against_brute_force(spark, monkeypatch, shard, entries):
    monkeypatch.setattr(language_model, "SHARD", shard)
    monkeypatch.setattr(language_model, "ENTRIES", entries)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "the", "the", f"w{rng.randrange(60)}", f"x{rng.randrange(900)}"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in collected(language_model.score(docs))}
    want, p, c = brute_model(rows)
    assert len(got) == len(want)
    for d, held, n, known, total, base, score in want:
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert (r["base_score"], r["score"]) == pytest.approx((base, score))
    assert sum(p("the", w) for w in [*c, "unseen"]) == pytest.approx(1)


def test_scores_of_awkward_documents(documents, nothing):
    got = collected(language_model.score(documents))
    want, *_ = brute_model([(r["doc_id"], r["text"]) for r in documents.collect()])

    def row(d, held, n, known, total, base, score):
        return (str(d), held, n, known, total, round(base, 4), round(score, 4))

    assert sorted(row(*(r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))) for r in got) == sorted(row(*w) for w in want)
    assert language_model.score(nothing).count() == 0
