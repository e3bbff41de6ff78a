"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps replace edges by edges to a smaller node and keep the components; the fixpoint is a set of stars
whose centres are the smallest nodes. Only edges are held, in the cluster; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.filter("b > a").join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reached.

    edges: two integer columns a and b, in any direction; loops and repeats are harmless.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = cut(edges), None
    for _ in range(most_rounds):
        now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen or not now[0]:
            break
        seen = now
        spent, state = state, cut(_small_star(_large_star(state)))
        drop(spent)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
