"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round is two aggregations with map-side minima and two joins on the node, whose hot keys adaptive execution
    splits; no neighbourhood is ever gathered. Self edges and repeats are ignored. The rounds end when the edges
    are stars: then a round changes nothing.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_mins(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "large")
        small = large.join(_mins(large), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = keep(small.select("e.*").where("a <> b").distinct(), "small")
        drop(now, large)
        got = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        now = small
        if seen == (got.n, got.s):
            break
        seen = (got.n, got.s)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
