"""Connected components of a graph given as an edge table, by contraction.

Every round, each remaining node hooks to its smallest neighbour if that is smaller than itself, the hooks are
followed to their ends by pointer jumping, and the edges are rewritten to those ends; edges inside one end
vanish. At least one end of every edge hooks, so the graph shrinks each round; a star is done in two.

Smallest neighbours are aggregates (combined before the shuffle), lookups are joins that Spark may split, so a
node with a third of all edges is no burden. Nothing but the number of edges left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.store import stored


def _jump(hooks: DataFrame) -> DataFrame:
    """(node, root) for a forest of (node, root) hooks: doubles the path each time until nothing moves."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        hooks = stored(hooks.join(up, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "hooks")
        moved = not hooks.where("moved").isEmpty()
        hooks = hooks.select("node", "root")
        if not moved:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node on an edge ``(a, b)``; the component is its smallest node.

    Loops, repeated and reversed edges are harmless; edges with a null end are no edges; no edges give no rows.
    """
    both = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    current = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = current.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    current = current.where("a <> b")
    while not current.isEmpty():
        ends = current.select("a", "b").union(current.select("b", "a"))
        hooks = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).where("root < node")
        roots = _jump(stored(hooks, "hooks"))
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        moved = current.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
        current = stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        labels = stored(labels.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), "labels")
    return labels.select("node", "component")
