"""Connected components by alternating large-star and small-star rounds, as DataFrame joins.

Each round is two aggregations and two joins; edges never grow in number. Minimums are aggregated map-side, and the join that hands
them back has an exchange of its own on both sides, so that adaptive execution can split a node with very many edges. Every half
round is written to the shared folder, so a lost executor costs one half round at most; a half round's table goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import discard, written


def _minimums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("m")).hint("rebalance")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = both.where("v > u")
    return larger.join(_minimums(both), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    moved = edges.join(_minimums(edges), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    return moved.unionByName(own).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge to another; roots themselves have no row."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        before, large = now, written(_large_star(now), "large-star")
        discard(before)
        now = written(_small_star(large), "small-star")
        discard(large)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(row)
