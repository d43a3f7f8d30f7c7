"""Connected components of a table of links by alternating large-star and small-star steps.

Each step is two group-bys and a join; links and labels stay distributed, and each round is written to
the shared folder. Rounds grow with the logarithm of the longest chain.

Cases: self-links and repeated links do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in ``links`` (a, b)."""
    e = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        e = materialise(_small_star(_large_star(e)), "stars")
    root = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialise(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root), "components")
