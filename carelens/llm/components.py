"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step on edges (u, v) with u > v.

    Large star: every neighbour above a node moves to the least node of its neighbourhood.
    Small star: every neighbour below a node, and the node itself, moves there. The minimum is a
    partial aggregate, and a hub's edges meet it in a join that adaptive execution can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the component's least node.

    Ends when the edges form stars, after a number of rounds that grows with the logarithm of
    the graph; every round is written to the shared folder.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(spark, e, "edges")
    before = None
    while True:
        e = saved(spark, _star(_star(e, large=True), large=False), "star")
        sums = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(CAST(xxhash64(u, v) AS decimal(38, 0)))")).first()
        if sums == before:
            break
        before = sums
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
