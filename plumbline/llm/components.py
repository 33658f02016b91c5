"""Connected components of a link table by alternating large and small stars.

Every step is a join and an aggregation over links, so hubs are combined before the shuffle or split by the join; the
links of each round are a written table. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.materialize import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to its smallest one: the larger neighbours, or itself and the smaller ones."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u != v").distinct()
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns u and v. Return node and component, its smallest node, for every node with a link."""
    now = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = materialize(_star(_star(now, True), False), "stars")
        shape = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(shape) == seen:
            break
        seen = tuple(shape)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
