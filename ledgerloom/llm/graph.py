"""Connected components as joins and aggregates; nothing but single flags comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def onward(classes: DataFrame, moved: DataFrame) -> DataFrame:
    """classes (node, root) with every root that moved (node, root) names replaced by where it went."""
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    return classes.join(to, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))


def components(links: DataFrame, parts: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b); nodes of one component share a root. With classes (node, root),
    which hold every node of links, what they join is joined already, and all their nodes are returned.

    Each round points a node at the neighbour of the least hash, follows the pointers twice, and replaces the
    links by those between the nodes pointed at. A star is one round; the number of rounds grows with the
    logarithm of the longest chain. Each round is written, so a lost executor repeats one round at most.
    """

    def moved(by: DataFrame) -> DataFrame:
        at = lambda name: by.select(F.col("node").alias(name), F.col("root").alias(f"{name}_to"))
        ends = links.join(at("a"), "a").join(at("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        return cut(ends.filter("a != b").distinct(), "links", parts)

    if classes is None:
        links = cut(links.select("a", "b").filter("a != b").distinct(), "links", parts)
        roots = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    else:
        roots, links = classes, moved(classes)
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
        points = least.select("node", F.least(own, F.col("m"))["v"].alias("root"))
        for _ in range(2):
            further = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            points = points.join(further, "root").select("node", F.col("next").alias("root"))
        points = cut(points, "points", parts)
        roots = cut(onward(roots, points), "roots", parts)
        links = moved(points)
    return roots
