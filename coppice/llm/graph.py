"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node reachable) of every node in ``edges`` (columns ``a, b``, no nulls).

    Large-star and small-star steps in turn: a step hangs a node's neighbours on the smallest of
    them. Each is a minimum by node and a join, so the neighbours of a hub are never in one place, and the number of
    rounds grows with the logarithm of the nodes. Rounds are staged, as lineage would grow
    with them; the loop ends when a round changes no edge. An empty table gives an empty one.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stage(links, "links")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("n", "m"))
        links = stage(small.filter("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    stars = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
