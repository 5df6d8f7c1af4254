"""Connected components by alternating large and small stars.

A round shuffles the edges by node, with partial minima before; no node's neighbours are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.plans import scratch


def _large(e: DataFrame) -> DataFrame:
    near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    return near.join(least.hint("merge"), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = near.join(least.hint("merge"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, least: the least node of its component, for every node that has an edge."""
    e = scratch.written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        last, e = e, scratch.written(_small(_large(e).where("u <> v").distinct()).where("u <> v").distinct(), "stars")
        scratch.discard(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark or not now["n"]:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
