"""Connected components of a link table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond") rewrite links until every node points at the smallest
node of its component.  Each step is a minimum per node and a join back, so
a hub's links are never gathered: the minimum is combined before the shuffle
and the join is one that adaptive execution can split.  Every round is
written by ``checkpoint()``; only two numbers come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v.  Large: every neighbour above a node is
    linked to the node's smallest neighbour (itself included); small: every
    node and its lower neighbours are linked to the smallest of them."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = (links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    return moved.where("u > v").distinct()


def components(links: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with a link to another; component is
    the smallest node reachable.  Nodes are longs; null ends are no links."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = materialize(links.where(a.isNotNull() & b.isNotNull() & (a != b))
                      .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    sign = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, large=True), large=False))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        sign = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
