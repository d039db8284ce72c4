"""Connected components of a staged edge table, by contraction.

Each round lets every node follow its smallest neighbour, replaces the ends of all edges by what they follow, and drops
edges that have become loops and repeats. Components shrink by half at least in each round, so the rounds grow with the
logarithm of the longest path; every round is staged, so a lost executor costs one round at most. Nothing but the count
of edges left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node that has an edge: label is the same in a component and differs between components.

    edges: columns a, b of one orderable type, none null. No edges give no rows.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        follow = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("w"))
        follow = staged(follow.select("v", F.least("v", "w").alias("w")), "follow")
        # a second hop halves the chains that are left
        hop = follow.select(F.col("v").alias("w"), F.col("w").alias("z"))
        follow = staged(follow.join(hop, "w").select("v", F.col("z").alias("w")), "follow")
        if labels is None:
            labels = follow.select(F.col("v").alias("node"), F.col("w").alias("label"))
        else:
            step = follow.select(F.col("v").alias("label"), F.col("w").alias("z"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("z", "label").alias("label"))
        labels = staged(labels, "labels")
        ends = [follow.select(F.col("v").alias(c), F.col("w").alias(f"{c}2")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = staged(moved.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
