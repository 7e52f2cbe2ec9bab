"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of every vertex to the least vertex of its neighbourhood.

    A large star moves the greater neighbours, a small star the smaller ones and
    the vertex. A hub is an aggregate and a skew-splittable join, never a list.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u")
    moved = both.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of edges (a, b) but the roots; the root is the least vertex reachable.

    Every round is written, so lineage stays short and lost executors cost one
    round. Ends when a round changes nothing; an edge table without rows gives none.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        return tuple(row)

    before = mark(now)
    while True:
        now = materialize(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        before = after
