"""Connected components of a link table by alternating star steps, entirely as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every id in ``links(a, b)``; the component is named by its smallest id.

    Large-star, then small-star: every node hands its neighbours over to the smallest one it knows.
    Each step is a map-side-combined minimum and an equi-join, so a node with very many links costs
    no more than its links; the graph shrinks to stars in a logarithmic number of rounds. No link
    table ever reaches the driver, only one count and checksum per round. Self links and repeated
    links are harmless; an empty table gives an empty result.
    """
    pairs = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    last = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("b", "a", "m")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        pairs = written(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    stars = pairs.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
    return stars.unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("component_id"))).groupBy("id").agg(F.min("component_id").alias("component_id"))
