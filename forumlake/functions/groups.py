"""Groups of nodes that links hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.session import freeze


def link_groups(links: DataFrame) -> DataFrame:
    """(node, grp): the smallest node that can be reached, for every node of `links` (a, b).

    Every node points at some node of its group and learns three things a round: where its
    target points, the smallest target of its neighbours, and, for that target, the same
    again. Pointers halve their way this way, so a chain of n links takes about log n rounds
    of two jobs. All are minima per node, combined before the shuffle; no neighbours are gathered.
    """
    both = freeze(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    pointers = freeze(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")).withColumnRenamed("a", "node"))
    while True:
        target = pointers.select(F.col("node").alias("up"), F.col("up").alias("far"))
        seen = pointers.join(target, "up")
        none = F.lit(None).cast(pointers.schema["up"].dataType)
        near = both.join(seen.select(F.col("node").alias("b"), "far"), "b").select(F.col("a").alias("node"), none.alias("up"), "far")
        low = (
            seen.select("node", "up", "far").unionByName(near)
            .groupBy("node").agg(F.max("up").alias("was"), F.min("far").alias("low"))
        )
        own = F.struct("node", F.col("low").alias("up"), "was")
        target = F.struct(F.col("was").alias("node"), F.col("low").alias("up"), none.alias("was"))
        told = low.select(F.inline(F.array(own, target)))
        after = freeze(told.groupBy("node").agg(F.min("up").alias("up"), F.max("was").alias("was")))
        if after.where("up <> was").isEmpty():
            return after.select("node", F.col("up").alias("grp"))
        pointers = after.select("node", "up")
