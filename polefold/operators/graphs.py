"""Connected components of tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links`` (a, b: long): the smallest node that can be reached.

    Alternates steps towards the smallest neighbour (of larger neighbours, then of smaller ones) until
    the links no longer change; rounds grow with the logarithm of a chain's length. A hub is
    aggregated before its shuffle, and only a count and a checksum reach the driver.
    """
    from ..plans.state import discard, materialise

    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            break
        before, old = state, now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = up.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(down.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(old)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
