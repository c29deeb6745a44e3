"""Connected components of a table of links, by alternating star contractions until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sized


def _large_star(links: DataFrame, count: int) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sized(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")), count)
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b")
    return sized(sized(moved, count).distinct(), count)


def _small_star(links: DataFrame, count: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sized(down.groupBy("a").agg(F.min("b").alias("root")), count)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b")
    return sized(sized(moved.unionByName(least.select("a", F.col("root").alias("b"))), count).distinct(), count)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b: long). No links give an empty table.

    A hub's links are reduced by partial minima, and the join back to them is an inner join that Spark may split.
    """
    now = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == seen or not state[0]:
            break
        seen, now = state, durable(_small_star(_large_star(sized(now, state[0]), state[0]), state[0]))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
