"""Connected components of an edge table, by alternating star contraction.

Every round points each node's larger neighbours at its smallest neighbour, then
each node and its smaller neighbours at the smallest of them. Edges never exceed
those of the start, so nothing of the size of a group's square arises; a node
with very many edges is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    pulled = down.join(least, "u").where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return pulled.union(least.select(F.col("u").alias("a"), F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it reaches. Nodes without edges are absent."""
    current = stored(edges.select("a", "b").where("a <> b").distinct())
    before = _state(current)
    while True:
        current = stored(_small_star(_large_star(current)))
        after = _state(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
