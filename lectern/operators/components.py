"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node.

    Each round links every node's larger neighbours to its least neighbour, then
    every node's smaller ones, until the edges are stars. A round aggregates
    before it shuffles and its edges never outnumber the round's before. Least
    neighbours are written before they are joined: then both sides of the join
    are shuffled as they are, and adaptive execution can split a node of many
    neighbours. They are merged at every size.
    """
    edges = stored(_ordered(edges.select("a", "b")), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == state:
            break
        state = now
        edges = stored(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = stored(least, "least")
    return _ordered(both.where("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    joined = edges.join(least.hint("merge"), "b")
    return _ordered(joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")))
