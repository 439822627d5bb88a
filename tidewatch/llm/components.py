"""Connected components of an edge table by alternating stars.

Each round sends every neighbour of a node to the smallest neighbour: first the
larger ones (large star), then the smaller ones (small star). Trees flatten in a
logarithmic number of rounds; edges never leave the cluster, and each round is
written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (smallest id reachable) for each node with an edge; edges: a, b (long)."""
    now = scratch.keep(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        after = scratch.keep(_small(_large(now).distinct()).distinct())
        stats = after.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20,0)))")).first()
        scratch.drop(now)
        now = after
        if tuple(stats) == mark:
            break
        mark = tuple(stats)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
