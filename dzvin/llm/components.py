"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dzvin.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, label): the smallest node reachable. Nodes without an edge are not listed.

    Each round hooks every node to its smallest neighbour, doubles the pointers until they reach the
    roots and contracts the edges onto them; at least half of the touched nodes go each round, and a path
    takes as many doublings as its length has binary digits. Nulls are dropped; loops and repeated edges
    do no harm.
    """
    left = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        parent = cut_lineage(parent)
        while True:
            # Two doublings to a job; most paths are short.
            top = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            once = parent.join(top, "up").select("node", F.col("up").alias("old"), F.col("top").alias("up"))
            twice = once.join(top, "up").select("node", F.col("top").alias("up"), (F.col("old") != F.col("top")).alias("moved"))
            doubled = cut_lineage(twice)
            parent = doubled.select("node", "up")
            if doubled.where("moved").isEmpty():
                break
        moved = parent if labels is None else labels.join(parent.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("up"))
        labels = cut_lineage(moved.withColumnRenamed("up", "label"))
        a = left.join(parent.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        ab = a.join(parent.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        left = cut_lineage(ab.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
