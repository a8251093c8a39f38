"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.stored import stored


def _to_least(links: DataFrame) -> DataFrame:
    """Links (u, v) with the least neighbour m of each u beside them.

    The minima are stored first, so that the join has plain shuffles on both sides and Spark
    can split a u with very many links over tasks.
    """
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    return links.join(least, "u")


def _are_stars(links: DataFrame) -> bool:
    """Whether every u has one link and no v is itself a u."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link: (node, component), the least node reachable.

    ``links`` has integer columns a and b; order, repeats and self-links do not matter.
    Alternates two steps until all links form stars: link greater neighbours of a node to
    its least neighbour, then link a node and its lesser neighbours to the least of them.
    Takes about as many rounds as the logarithm of the longest path.
    """
    ends = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = stored(links.where("a <> b").select(*ends).distinct(), "links")
    while not _are_stars(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_to_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large-star")
        near = _to_least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        current = stored(small.distinct(), "small-star")
    named = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
