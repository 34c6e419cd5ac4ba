"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), both long; component is the least node reachable.

    Alternates the large-star and small-star steps until nothing changes. Each round is a fixed number of shuffles
    on long pairs, whose minima are combined before they move; a node with very many neighbours meets them in a join
    of two shuffled sides, which the adaptive plan splits where it is skewed. Each round is checkpointed. Loops, repeats and an empty graph are allowed.
    """
    at = checkpoint(edges.where("a <> b").select("a", "b").distinct())
    before = _state(at)
    while before[0]:
        at = checkpoint(_small_star(_large_star(at)))
        now = _state(at)
        if now == before:
            break
        before = now
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
