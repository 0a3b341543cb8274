"""The registered queries of this package: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op8_pfair_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

URL_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
links AS (
  SELECT url, unnest(list_transform(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?i)<(?:link|meta)\s[^>]*>'), lambda t:
    CASE WHEN regexp_matches(t, '(?is)^<link\s.*\brel\s*=\s*("([^"]*\s)?canonical(\s[^"]*)?"|''([^'']*\s)?canonical(\s[^'']*)?''|canonical[\s/>])')
           THEN regexp_extract(t, '(?i)\shref\s*=\s*["'']?([^"''>\s]+)', 1)
         WHEN regexp_matches(t, '(?is)^<meta\s.*\bhttp-equiv\s*=\s*["'']?refresh["''\s/>]')
           THEN regexp_extract(t, '(?i)\scontent\s*=\s*["'']?\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*["'']?([^"''>\s;]+)', 1) END) || [
    regexp_replace(regexp_replace(regexp_replace(url, '[?](utm_[a-z]+|fbclid|gclid)=[^&#]*(#|$)', '', 'g'), '(?s)#.*$', ''), '^http://', 'https://')]) AS target
  FROM pages WHERE contains(url, '://')),
edges AS (
  SELECT url AS a, CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^([^:/?#]*:)//', 1) || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || target END AS b FROM links),
both_ways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
urls AS (SELECT url FROM parts UNION SELECT a FROM both_ways),
places AS (
  SELECT url, translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM urls WHERE instr(url, '://') > 0),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
decided AS (
  SELECT url, h || p AS rule, v AS decision FROM places, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(h || p) DESC, length(h) DESC, v) = 1),
hit AS (
  SELECT url FROM decided WHERE decision = 'block'
  UNION SELECT b FROM hit JOIN both_ways ON a = url)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN url IN (SELECT url FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN decided USING (url)
"""


@query("op6_url_filters", URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.urls import judge, rules

    return judge(table(spark, sf_dir, "pages"), rules(spark, RULES))


REVISIT_SQL = """
WITH headers AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
judged AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) ELSE page_id END AS original FROM headers)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to, true AS digest_ok FROM judged
"""


@query("op3_revisit_resolution", REVISIT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.warc import deduplicate
    from pulsegrid.session import scratch

    return deduplicate(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


@query("op10_backoff_automaton")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


@query("op9_lookup_sketch")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.fingerprints import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


JOIN_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), ' | ')) AS h, s FROM sets),
distinct_sets AS (SELECT min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM sizes WHERE n > 0 GROUP BY h),
grams AS (SELECT id, n, unnest(s) AS g FROM distinct_sets),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS both_, any_value(a.n) AS n1, any_value(b.n) AS n2
           FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * both_ >= 90 * (n1 + n2 - both_)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS id, x AS r FROM both_ways UNION SELECT reach.id, y FROM reach JOIN both_ways ON r = x),
least AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
classes AS (SELECT h, min(doc_id) AS id FROM sizes WHERE n > 0 GROUP BY h)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE coalesce(component, classes.id) END AS component_id
FROM sizes LEFT JOIN classes ON sizes.h = classes.h AND n > 0 LEFT JOIN least ON least.id = classes.id
"""


@query("op1_ngram_jaccard_join", JOIN_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"))


@query("op7_semi_markov_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"))


@query("op4_ordinal_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.quality import fit, rate

    docs = table(spark, sf_dir, "documents")
    return rate(docs, fit(docs, table(spark, sf_dir, "labels")))


@query("op2_collision_counting")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


AUDIT_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM split LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS fails, count(*) AS n FROM failing GROUP BY ALL),
letters(l) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s.l AS step FROM orders, letters s),
judged AS (
  SELECT part, o, step, n, good, toxic, fails[o[step]] AS here,
         len(list_filter(o[:step - 1], lambda k: fails[k])) > 0 AS before, len(list_filter(fails, lambda x: x)) AS many
  FROM cells, steps),
counts AS (
  SELECT part, o, step, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT before THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM counts
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in every tenth document by the checksum of its id, words from one on repeat a few before them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), "")
    docs = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(block, F.lit(1), rest)), " ")
    return docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), edited).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.periodic import collapse

    found = collapse(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))


@query("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.licenses import scan

    base, starts = F.array_distinct("places.label"), F.col("places.start")
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("detections.label"))), ",").alias("labels"), "score")
