"""Connected components by alternating large and small stars, in DataFrame operations only.

Each round points every node's larger neighbours at its smallest neighbour, so chains
shrink by a constant factor and hubs never grow.  Minima come from partial
aggregates; they are written before they are joined, so Spark can split the rows of a
hub.  Edges and rounds live in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import cut, remove

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b; long): the smallest node of its component.

    Nulls and loops are ignored; repeated edges count once.  The result is written (see
    ``cut``); the rounds' own files are gone when this returns.
    """
    spark = edges.sparkSession
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, last = cut(pair.distinct(), "stars"), None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        least = _least(both)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(large.distinct(), "stars")
        remove(spark, now, least)
        # small star: u and its smaller neighbours go to the smallest of them
        least = _least(large)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "stars")
        remove(spark, large, least)
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).collect()[0]
        if found == last:
            break
        last = found
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = cut(named, "components")
    remove(spark, now)
    return out
