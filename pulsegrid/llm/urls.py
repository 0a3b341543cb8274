"""Allowing and blocking urls by rules that carry over to aliases.

A rule names a host and a path prefix and holds for the host and all its subdomains; of the rules that fit a
url the longest wins (host and path together, then the longer host, then allow before block). A url that no
rule fits is blocked if it is an alias of a blocked one: redirects, canonical links and a url's normal form
are edges of a graph, and a block decision reaches the whole connected component. A url's own rule goes before
what reaches it, so an explicit allow stays. Anything else is allowed.

DataFrame functions only. Rules are joined on the suffixes of the host, not tried one by one. Urls, not pages,
are decided on and join back to their pages, and components come from combined aggregates, so a host, url or
alias group with a third of all rows stays spread.

* null url or one without ``://``: host and path are empty, no rule fits, verdict allow, rule null;
* null html, or html without links: no edges but the normal form; a link that resolves to no url with ``://``: no edge;
* repeated pages: each row gets its verdict; empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm.components import components
from pulsegrid.llm.store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"(?i)<(?:link|meta)\s[^>]*>"
CANONICAL = r"""(?is)^<link\s.*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
HREF = r"""(?i)\shref\s*=\s*["']?([^"'>\s]+)"""
REFRESH = r"""(?is)^<meta\s.*\bhttp-equiv\s*=\s*["']?refresh["'\s/>]"""
TARGET = r"""(?i)\scontent\s*=\s*["']?\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*["']?([^"'>\s;]+)"""  # after no delay
TRACKING = "^(utm_[a-z]+|fbclid|gclid)="


def rules(spark: SparkSession, listed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, verdict)`` rows as a table."""
    rows = [{"host": h, "path": p, "verdict": v} for h, p, v in listed]
    kind = "array<struct<host:string,path:string,verdict:string>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def normal_form(url: Column) -> Column:
    """Without fragment and tracking parameters, https for http; a query of nothing else goes."""
    whole = F.regexp_extract(url, "(?s)^([^#]*)", 1)
    every = F.split(F.regexp_extract(whole, "(?s)^[^?]*[?](.*)$", 1), "&")
    kept = F.filter(every, lambda x: ~x.rlike(TRACKING))
    query = F.array_join(kept, "&")
    cut = F.concat(F.regexp_extract(whole, "(?s)^([^?]*)", 1), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.regexp_replace(F.when(F.size(kept) < F.size(every), cut).otherwise(whole), "^http://", "https://")


def without_dots(path: Column) -> Column:
    """A rooted path without the segments ``.`` and ``..``."""
    step = F.split(path, "/")
    walked = F.aggregate(F.slice(step, 2, F.size(step)), F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done)
                         .when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    end = F.when(F.element_at(step, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(walked, "/"), end)


def resolved(target: Column, url: Column) -> Column:
    """The absolute url of a link's target on a page (RFC 3986; a ``base`` element isn't looked at); null where it isn't one with ``://``."""
    base = F.regexp_extract(url, "^([^:/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, "^([^:/?#]*:)//", 1)
    page = F.regexp_extract(url, "^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(page, "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    path, rest = F.regexp_extract(target, "^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    return (F.when(target == "", None).when(target.rlike("^[^:/?#]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, target))
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)  # mailto: and the like
            .when(target.startswith("/"), F.concat(base, without_dots(path), rest))
            .when(target.startswith("#"), F.concat(F.regexp_extract(url, "(?s)^([^#]*)", 1), target))
            .when(target.startswith("?"), F.concat(base, page, target))
            .otherwise(F.concat(base, without_dots(F.concat(folder, path)), rest)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)`` urls of the same content: canonical links, immediate redirects, normal forms of both ends of these and of all urls.

    All links of a page count, with ``canonical`` among the words of ``rel``; a refresh after a delay and what stands in a comment don't."""
    url = F.col("url")
    tags = F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(TAG), F.lit(0))
    found = F.transform(tags, lambda t: F.when(t.rlike(CANONICAL), F.regexp_extract(t, HREF, 1)).when(t.rlike(REFRESH), F.regexp_extract(t, TARGET, 1)))
    targets = F.transform(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: resolved(t, url))
    ends = F.array_append(targets, url)
    links = F.concat(F.transform(targets, lambda b: F.struct(url.alias("a"), b.alias("b"))),
                     F.transform(ends, lambda a: F.struct(a.alias("a"), normal_form(a).alias("b"))))
    return (pages.where(url.contains("://")).select(F.explode(links).alias("e")).select("e.a", "e.b")
            .where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())


def explicit(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``url, host, path, rule, decision`` of each distinct url; the last two are null where no rule fits."""
    order = W.orderBy(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.desc("rule_verdict"),
                      "rule_host", "rule_path")  # over the rules only
    ranked = listed.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
                           F.col("verdict").alias("rule_verdict")).distinct().withColumn("rank", F.row_number().over(order))
    host, path = host_path(F.col("url"))
    split = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = (split.select("url", "path", F.explode(suffixes).alias("rule_host")).join(ranked, "rule_host")
               .where(F.col("path").startswith(F.col("rule_path"))).groupBy("url").agg(F.max("rank").alias("rank")))
    named = fitting.join(ranked, "rank").select("url", F.concat("rule_host", "rule_path").alias("rule"),
                                                F.col("rule_verdict").alias("decision"))
    return split.join(named, "url", "left")


def judge(pages: DataFrame, listed: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``edges`` defaults to :func:`alias_edges`."""
    edges = stored(alias_edges(pages) if edges is None else edges.select("a", "b"), "aliases")
    urls = pages.select("url").union(edges.select("a")).union(edges.select("b"))
    decided = stored(explicit(urls, listed), "decided")
    groups = components(edges)
    blocked = (groups.join(decided.where("decision = 'block'"), groups["node"] == decided["url"], "left_semi")
               .select("component").distinct())
    reached = groups.join(blocked, "component", "left_semi").select(F.col("node").alias("url"), F.lit("block").alias("reached"))
    verdicts = decided.join(reached, "url", "left").select(
        "url", "rule", F.coalesce("decision", "reached", F.lit("allow")).alias("verdict"))
    host, path = host_path(F.col("url"))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(verdicts, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
