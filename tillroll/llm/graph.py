"""Connected components of large graphs as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import stage


def _mark(edges: DataFrame) -> tuple:
    found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return found[0], found[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), the root being the smallest node that can be reached.

    Each round hangs the larger neighbours of a node under its smallest one, then the smaller ones; both are an aggregation
    and a join on the node, which Spark splits where a node has many neighbours. Ends when all edges lead to the root,
    after a number of rounds that grows with the logarithm of the graph's diameter. Only counts reach the driver.
    """
    pair = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    now = stage(pair.distinct(), "graph-edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).union(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        large = stage(large, "graph-large")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        hung = large.join(least, "high")
        small = hung.where(F.col("low") != F.col("m")).select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = stage(small.union(least.select("high", F.col("m").alias("low"))).distinct(), "graph-round")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.union(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
