"""Connected components over an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def components(edges: DataFrame, labels: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(id, label): the smallest id of each node's component, for the nodes of the edges (a, b).

    Every round hooks each root that has a smaller neighbour to the smallest, follows the hooks to their
    ends by doubling, and renames the edges; each component that is not done at least halves. With labels
    of earlier edges, only the edges in `more` are still to do.
    """
    ends = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct()
    if labels is None:
        labels, left = stored(ends.withColumn("label", F.col("id"))), edges.where("a <> b")
    else:
        labels = stored(ends.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
        left = renamed(more, labels)
    left = stored(left)
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"))
        while True:
            next_ = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            if hooks.join(next_, "b", "left_semi").isEmpty():
                break
            hooks = stored(hooks.join(next_, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
        moved = hooks.select(F.col("a").alias("label"), F.col("b").alias("root"))
        labels = stored(labels.join(moved, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
        moved = moved.select(F.col("label").alias("id"), F.col("root").alias("label"))
        left = stored(renamed(left, moved))
    return labels


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between the labels of their ends, once each, without loops."""
    a, b = (names.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    out = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
