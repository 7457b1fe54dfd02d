"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no task holds a component, and a node with very many edges meets only
aggregates with map-side combination and joins that Spark can split. The number of edges never grows; a few rounds
reach a star per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stash


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b). Loops and repeats do not matter.

    An empty edge table gives an empty result.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = stash(edges.where("a != b").select(most.alias("a"), least.alias("b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds if before[0] else 0):
        # large star: a node's larger neighbours are hung on the smallest of its neighbours and itself
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = stash(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
