"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import drop_stash, stash


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long; root is the
    component's smallest node.  Loops and repeated edges are fine; nulls are not.

    Each round is written to the shared folder.  Stars of the least nodes are what
    remains, so the number of rounds grows with the logarithm of the longest path.
    """
    current = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(current)
    for _ in range(rounds):
        following = stash(_small_star(_large_star(current)), "edges")
        after = _signature(following)
        drop_stash(current)
        current = following
        if after == before:
            roots = current.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
