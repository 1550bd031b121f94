"""Connected components by alternating large-star and small-star steps, written after each round.

A node's neighbours meet only in aggregates that combine before their shuffle and in joins that
may be split, so that a star with a third of all nodes is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join's sides are plain shuffles, of which a star's part can be split
    least = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{name}_large")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    edges = scratch.save(edges, f"{name}_edges")
    least = scratch.save(edges.groupBy("a").agg(F.min("b").alias("m")), f"{name}_small")
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is its least node."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before, k = scratch.save(ordered, f"{name}_0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, k = state, k + 1
        now = scratch.save(_small_star(scratch, _large_star(scratch, now, f"{name}_{k}"), f"{name}_{k}").distinct(), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
