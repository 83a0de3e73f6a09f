"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, join_hot


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each step keeps at most as many edges as there were, a step's sums are combined before the shuffle, the centre of a
    large star is joined by broadcast, and the
    tables are written between steps, so a lost executor repeats one step at most.
    """
    now = cut(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph"
    )
    seen = _mark(now)
    for _ in range(max_rounds):
        # Large star: every larger neighbour points to the smallest of a node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both.where("b > a"), low, ["a"], 2 * seen[0]).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = large.join(low, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
        small = pairs.select("e.a", F.col("e.low").alias("b")).where("a != b").distinct()
        then = cut(small, "graph")
        mark = _mark(then)
        discard(now)
        now = then
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
