"""Connected components of a table of links, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.session import materialize


def _lowest(df: DataFrame) -> DataFrame:
    """For each node its lowest neighbour, or itself if lower."""
    return df.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Higher neighbours of a node are linked with its lowest neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked with the lowest of them. ``links`` has v < u."""
    joined = links.join(links.groupBy("u").agg(F.min("v").alias("low")), "u")
    moved = joined.filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(joined.select("u", F.col("low").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """u, root: the lowest node reachable, for every node that has a link to a lower one. ``links`` has two columns.

    Large and small stars alternate until each node is linked with one root;
    stars have no chains left, so rounds grow with the logarithm of a
    component's size. A node with a third of all links is one group of a
    partial minimum and one key of a join that Spark can split.
    """
    a, b = links.columns
    now = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    while True:
        once = _large_star(now).filter("u > v").distinct()
        after = materialize(_small_star(once).filter("u > v").distinct(), "links")
        # Done when every node has one link and no node is both linked and a root.
        twice = after.groupBy("u").count().filter("count > 1")
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if twice.isEmpty() and chained.isEmpty():
            return after.select("u", F.col("v").alias("root"))
        now = after
