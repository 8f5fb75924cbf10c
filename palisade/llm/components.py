"""Connected components of an edge table by alternating star contractions, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the least node of its component, as a table.

    Each round is written to the shared folder, so that the lineage stays short and lost executors cost one round
    at most; rounds before the last are deleted. Edges from a node to itself and repeated ones make no difference; rows with a null end are no edges.
    """
    spark = edges.sparkSession
    last = common.Scratch(spark)
    now = last.written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        own = common.Scratch(spark)
        after = own.written(_small_star(_large_star(now)))
        last.clear()
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, last = after, own
        if mark == state or mark[0] == 0:
            break
        state = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
