"""Connected components over edges as tables: smallest label along hooks and shortcuts, every round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.llm.kit import Tables


def components(edges: DataFrame) -> DataFrame:
    """`node, component` (the smallest node it is linked with) for all nodes of `edges` (`a, b`).

    Alternates two star operations: every node hands its larger, then its smaller neighbours to its smallest one. The
    edge count never grows and the rounds grow with the logarithm of the longest path. Groups are summed up by `min`,
    which Spark combines before it shuffles, and joined back, which adaptive execution splits; none is collected. A
    round's tables are deleted once the next one is stored.
    """
    tables = Tables(edges.sparkSession)
    now = tables.keep(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours (and the node itself never) move to the node's smallest neighbour or itself.
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = tables.keep(both.filter("y > x").join(low, "x").filter("y != m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # Small star: smaller neighbours move to the smallest of them, and so does the node.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = tables.keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        settled = after.agg(F.count("*"), mark).first() == now.agg(F.count("*"), mark).first()
        tables.drop(large, now)
        if settled:
            nodes = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = after
