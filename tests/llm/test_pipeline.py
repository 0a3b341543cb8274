import os

import duckdb
import pytest

import corpus_pipeline
from pulsegrid.llm import jaccard, pii, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.exceptAll(before.select(*docs.columns)).count() == 0 or name == "pii"
    chosen, single, clean, mixed, packed = kept.values()
    groups = jaccard.link_components(chosen, corpus_pipeline.NEAR)
    assert single.count() == groups.select("component_id").distinct().count()
    assert clean.count() == single.count() == mixed.count()
    assert not [r for r in clean.collect() if pii.base_spans(r["text"] or "")]
    assert sorted(r[0] for r in mixed.select("doc_id").collect()) == sorted(r[0] for r in clean.select("doc_id").collect())
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in mixed.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_of_awkward_documents(spark, documents, nothing):
    for start in (documents, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
            assert name == "packing" or docs.columns == documents.columns
        assert docs.columns[0] == "doc_id"


def test_python_gets_few_texts_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(key), spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("70", "70")):
            for name in ("quality_classifier", "ngram_jaccard_join", "pii", "packing"):
                spark.conf.set(key, given)
                stages[name](spark, docs.limit(40), SF)
                assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_sequences_follow_the_mix(spark):
    sizes = {"hot": 3000, "b": 1000, "c": 1000, "d": 1000}
    rows = [(i, "some words of a text " * (20 + i % 37), "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.stored(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).where("start = 0").orderBy("sequence_id", "offset").collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(6000))
    names = [rows[r["doc_id"]][3] for r in packed]
    weights = {s: n ** 0.5 for s, n in sizes.items()}
    for begin in range(0, 4000, 500):  # all sources last until about document 4,700
        for s, w in weights.items():
            assert abs(names[begin:begin + 500].count(s) / 500 - w / sum(weights.values())) < 0.09
    assert set(names[5200:]) == {"hot"}


def test_one_row_of_each_group_of_near_duplicates(spark):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(60))

    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (4, text(1) + " end"), (None, text(2)), (None, text(2)), (None, text(1)),
            (5, text(3)), (6, text(3)), (6, text(4)), (None, text(5)), (7, text(5)), (8, ""), (9, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, text(1)), (None, text(2)), (5, text(3)), (6, text(4)), (7, text(5)), (8, ""), (9, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
