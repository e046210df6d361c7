"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage, cuts_of, drop_cuts


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node that a link
    ``a, b`` names.  Null ends and links of a node to itself are left out.

    Alternating star steps: each node first hands its larger neighbours, then
    its smaller ones, to the smallest it knows, until nothing changes (about
    the logarithm of the longest path in rounds).  Every round is a grouped
    minimum, combined before its shuffle, and a join, written to the shared
    checkpoint folder; the rounds before are deleted."""
    spark = links.sparkSession
    start = len(cuts_of(spark))
    edges = cut_lineage(links.filter("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        earlier = cuts_of(spark)[start:]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours of u go to u's least
        edges = both.filter(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = cut_lineage(edges)
        # u and its smaller neighbours go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(edges)
        drop_cuts(spark, [*earlier, *cuts_of(spark)[start + len(earlier) : -1]])
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
