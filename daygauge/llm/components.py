"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygauge.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)`` of longs; the component is its smallest node.

    Each round links every larger neighbour of a node, then every smaller one, to the smallest; the minimum per node is an
    aggregate, so a node with very many links is not gathered. Each round is a written table; rounds grow with the logarithm of
    a chain's length. Equal ends and repeated edges are ignored; no edge, no row.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if (count, total) == seen or not count:
            break
        seen = count, total
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
