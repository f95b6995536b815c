"""Connected components of a graph of links by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import stored


def labels(edges: DataFrame, a: str, b: str, node: str, label: str) -> DataFrame:
    """``node, label`` for every node of an edge list: the smallest node of its component.

    Alternating large-star and small-star rounds (each node links its larger,
    then its smaller neighbours to its smallest): the number of rounds grows
    with the logarithm of the nodes, no round holds a component in one task
    longer than a grouped minimum, and each round is stored.  Null ends and
    loops are ignored."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = stored(links, "component_links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u > v")
        links = stored(small.unionByName(least.select("u", F.col("w").alias("v"))).distinct(), "component_links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = links.select(F.col("v").alias(node), F.col("v").alias(label)).distinct()
    return links.select(F.col("u").alias(node), F.col("v").alias(label)).unionByName(ends)
