"""Connected components by alternating large-star and small-star rounds.

Each round is two shuffles of the links; links are rewritten towards the smallest
neighbour, so their number never grows. Every round is written to the shared folder,
which cuts lineage and survives lost executors. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.storage import Scratch

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u > v); returns links (u > v) again."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is its component's smallest node.

    Links are pairs of integers in any order, repeated or not; null ends and loops
    are ignored. No links give no rows.
    """
    scratch = Scratch(spark, "components")
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and v is not null").distinct()
    now, last = scratch.table(now, "r0"), None
    for k in range(1, MOST_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
        now = scratch.table(_star(_star(now, large=True), large=False), f"r{k}")
        scratch.drop(f"r{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
