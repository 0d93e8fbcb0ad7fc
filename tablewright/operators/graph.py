"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import write_table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node that it reaches.

    Large-star hangs each larger neighbour of a node on the smallest one, small-star each smaller one; once neither
    changes an edge all components are stars.  The number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder.
    """
    def large_star(edges: DataFrame) -> DataFrame:
        around = _both_ways(edges)
        low = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        hung = around.join(low, "a").where(F.col("b") > F.col("a"))
        return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        hung = edges.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return hung.unionAll(low.select("a", F.col("low").alias("b"))).distinct()

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        edges = write_table(small_star(large_star(edges)))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
