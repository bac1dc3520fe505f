"""Connected components of a link table by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `links` (a, b).

    Large-star and small-star steps: every node hands the smallest neighbour to its other
    neighbours until all links point to a smallest node. Neighbours are never gathered in a
    group: each step is a minimum per node, combined before the shuffle, and a join. A
    logarithmic number of rounds, each one cut by a written table.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        stars = small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        after = stored(stars.where("a <> b").distinct(), "links")
        # settled once every node has one link and no target has a link itself
        unsettled = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi")
        if not unsettled.unionByName(chained).take(1):
            roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        edges = after
