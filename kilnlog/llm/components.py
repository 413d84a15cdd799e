"""Connected components by alternating large and small stars; each round is two grouped minima and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.common import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (a, b) with a > b: larger neighbours, then smaller ones and the node itself, go to the least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), F.least("_m", "a").alias("_m"))
    large = edges.join(least, F.col("b") == F.col("_n")).select("a", F.col("_m").alias("b")).unionByName(least.where("_n <> _m").select(F.col("_n").alias("a"), F.col("_m").alias("b")))
    least = large.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), "_m")
    small = large.join(least, F.col("a") == F.col("_n")).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return small.unionByName(least.select(F.col("_n").alias("a"), F.col("_m").alias("b"))).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in edges(a, b); root is the least node of its component."""
    edges = materialise(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    while True:
        # stars: a node with a centre has one centre and is none itself
        ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf"))))
        ends = edges.select(ends.alias("_e")).groupBy("_e.n").agg(F.sum("_e.leaf").alias("leaf"), F.count(F.lit(1)).alias("all"))
        if ends.where("leaf > 1 or (leaf = 1 and all > 1)").isEmpty():
            break
        edges = materialise(spark, _stars(edges), "cc")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
