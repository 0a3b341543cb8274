"""Interaction of document filters: what each removes at every step of every order in which they can be applied.

1. *Cells.* A document becomes a mask, one bit for each filter it fails. Only counts by part, mask and labels go on, at
   most parts x 2^filters x 4 rows, however many documents there are.
2. *Recursion.* A recursive table expression starts with the masks and no filter. Each level joins the mask cells of the
   filters not applied yet, carries the bits of those that are, and emits for every prefix of an order which masks its
   last filter removes, finds removed already, or leaves. 2^5 masks and 326 prefixes are 10,432 rows, whatever the input.
3. *Metrics.* Cells meet the levels on their mask; an order reads the row of its prefix at each step, so the 120 orders of five
   filters share 325 prefixes.

Duplicates (filter ``E`` by default) are texts equal to that of a smaller id: texts travel as SHA-256 digests, the smallest
id of a digest is an aggregate, and rows join on digest *and* id, so a group of copies of any size is dealt over all tasks.

* null text: the empty text; null or empty part: the part ``''``;
* null id: never a duplicate and never labelled, but counted; rows that repeat an id and text aren't duplicates of each other;
* labels: a document is good (toxic) if any row of ``labels`` for its id says 1; null labels, and labels of other ids, count for nothing;
* no documents: no parts, no rows. Extra columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.store import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Letter of a filter -> whether a document fails it, of its text and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 3 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
DUPLICATES = "E"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

STEPS = """
WITH RECURSIVE steps(filter_order, applied, step, letter, mask, kept, removed, redundant, only) AS (
  SELECT '', 0, 0, '', mask, true, false, false, false FROM {masks}
  UNION ALL
  SELECT concat(steps.filter_order, cell.letter), steps.applied | cell.bit, steps.step + 1, cell.letter, steps.mask,
         (steps.mask & (steps.applied | cell.bit)) = 0,
         cell.fails AND (steps.mask & steps.applied) = 0,
         cell.fails AND (steps.mask & steps.applied) <> 0,
         steps.mask = cell.bit
  FROM steps JOIN {mask_cells} cell ON steps.mask = cell.mask AND (steps.applied & cell.bit) = 0)
SELECT filter_order, step, letter, mask, kept, removed, redundant, only FROM steps WHERE step > 0
"""


def masked(docs: DataFrame, filters: dict, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, part, digest, mask, n``: the filters on single documents; equal rows are counted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(fails(text, words), 1 << k).otherwise(0))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    return rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame, filters: dict, duplicates: str, *, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic, n``; the last bit of a mask is for duplicates."""
    rows = stored(masked(docs, filters, id_col, text_col, part_col), "masked")
    named, nameless = rows.where("id IS NOT NULL"), rows.where("id IS NULL")  # null keys would meet in one task
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    bit = F.when(F.col("first"), 0).otherwise(1 << len(filters))
    told = named.join(first, ["digest", "id"], "left").join(marks, "id", "left").select(
        "part", F.col("mask").bitwiseOR(bit).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    untold = nameless.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return told.union(untold).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def steps(masks: DataFrame, letters: list[str]) -> DataFrame:
    """What the last filter of each prefix of an order does to each mask: the recursion."""
    one = F.explode(F.array(*(F.struct(F.lit(letter).alias("letter"), F.lit(1 << k).alias("bit")) for k, letter in enumerate(letters))))
    mask_cells = masks.select("mask", one.alias("cell")).select("mask", "cell.*").withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return masks.sparkSession.sql(STEPS, masks=masks, mask_cells=mask_cells)


def audit(docs: DataFrame, labels: DataFrame, *, filters: dict = FILTERS, duplicates: str = DUPLICATES, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step``, the counts and ``shapley`` for each part, order of all filters, and step.

    ``kept`` documents are left after the step, ``removed`` go at it, ``redundant`` fail its filter but went before,
    ``unique_fails`` fail no other filter; ``good_lost`` and ``toxic_lost`` are of the removed. ``shapley`` sums what the step's
    filter removes over all orders.
    """
    letters = [*filters, duplicates]
    counted = stored(cells(docs, labels, filters, duplicates, id_col=id_col, text_col=text_col, part_col=part_col), "cells")
    levels = stored(steps(counted.select("mask").distinct(), letters), "steps")  # at most 2^letters masks for each prefix
    sums = [F.sum(F.when(F.expr(of), F.col("n")).otherwise(0)).alias(name) for name, of in zip(
        COUNTS, ["kept", "removed", "redundant", "only", "removed AND good", "removed AND toxic"], strict=True)]
    by_prefix = stored(counted.join(F.broadcast(levels), "mask").groupBy("part", "filter_order", "step", "letter").agg(*sums), "prefixes")
    orders_of = F.element_at(F.array(*(F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1))), F.col("step"))
    shapley = by_prefix.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = (levels.where(F.col("step") == len(letters)).select("filter_order").distinct()
              .select(F.col("filter_order").alias("whole"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
              .select("whole", F.expr("substring(whole, 1, at)").alias("filter_order")))  # a letter is one character
    return (by_prefix.join(F.broadcast(orders), "filter_order").join(shapley, ["part", "letter"])
            .select("part", F.col("whole").alias("filter_order"), "step", *COUNTS, "shapley"))
