"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import release, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of the links ``a, b`` (numbers): the smallest node that
    can be reached. Links of a node to itself and links with a null are ignored.

    Each round hangs every node below its smallest neighbour, links its other smaller neighbours
    to that one, and moves every node up to its parent's parent; the number of rounds grows with
    the logarithm of the longest chain. Rounds are stored, so a lost executor repeats one at most.
    """
    edges = stored(_downward(links, "a", "b"), "links")
    while True:
        # The smallest smaller neighbour of each node, found with partial aggregation.
        parents = stored(edges.groupBy("a").agg(F.min("b").alias("parent")), "parents")
        hung = edges.join(parents, "a")
        others = hung.where("b <> parent").select(F.col("b").alias("a"), F.col("parent").alias("b"))
        near = parents.select("a", F.col("parent").alias("b")).unionByName(others)
        up = parents.select(F.col("a").alias("b"), F.col("parent").alias("above"))
        raised = near.join(up, "b", "left").select(
            "a", F.coalesce("above", "b").alias("b"), F.col("above").isNotNull().alias("moved")
        )
        following = stored(_downward(raised, "a", "b", "moved"), "links")
        moved = following.where("moved").limit(1).count() or others.limit(1).count()
        release(edges)
        if not moved:
            release(following)
            break
        release(parents)
        edges = following.select("a", "b")
        edges._stored_path = following._stored_path
    roots = parents.select(F.col("parent").alias("node")).distinct()
    return parents.select(F.col("a").alias("node"), F.col("parent").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _downward(links: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), *more)
    if more:
        return ends.groupBy("a", "b").agg(*(F.max(name).alias(name) for name in more))
    return ends.distinct()
