"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours of a node, or the node and its smaller ones."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if large:
        hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        smaller = both.filter("b < a")
        hung = smaller.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smaller.groupBy("a").agg(F.min("b").alias("b")))
    return hung.filter("a <> b").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is named by its smallest node.

    Rounds grow with the logarithm of the longest chain; each is a written table, so a lost
    executor costs one round. The driver sees two numbers a round.
    """
    current = saved(links.filter("a <> b").distinct(), spark, "links")
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if state == before:
            break
        before = state
        current = saved(_star(_star(current, True), False), spark, "links")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
