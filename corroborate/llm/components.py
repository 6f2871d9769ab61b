"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node next to it."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node (a, the larger end) and its smaller neighbours move to the smallest of them."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) of any direction, repeated or not; returns (node, root) for every node that has an edge, root the smallest reachable.

    Joins are merge joins: edges to one root take few bytes on disk, and so many of them would pass for a small table.  The
    least neighbours are written first, so that a join shuffles both sides anew and can be split at a node with many edges.
    Every round ends in a written table, so that lost executors cost one round; the number of rounds is logarithmic in
    the longest path.  Self-edges and null ends are dropped.
    """
    now = written(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        now = written(_small(_large(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
