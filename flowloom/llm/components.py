"""Connected components by contraction, as rounds of joins and minima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.plans.lineage import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), one row for each node that has a link.

    Every round lets each node point at the neighbour (or itself) whose hash for that
    round is the least, and contracts the links to the pointed-at nodes. A hash drawn
    anew each round keeps chains from shrinking one node at a time, so the number of
    rounds follows the logarithm of the longest path. Hubs cost nothing extra: the least
    hash is combined before the shuffle, and joins on a hub can be split.
    Self-links are ignored; an empty input gives an empty result.
    """
    links = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct())
    start = links.select(F.col("a").alias("node")).distinct()
    hops: list[DataFrame] = []
    while not links.isEmpty():
        order = lambda c, salt=len(hops): F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), c.alias("n"))
        parent = written(
            links.groupBy("a")
            .agg(F.min(order(F.col("b"))).alias("near"))
            .select("a", F.least(F.col("near"), order(F.col("a")))["n"].alias("p"))
        )
        hops.append(parent)
        left, right = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        links = written(
            links.join(left, "a").join(right, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        )
    follow = lambda found, hop: found.join(hop.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return reduce(follow, hops, start.withColumn("root", F.col("node")))
