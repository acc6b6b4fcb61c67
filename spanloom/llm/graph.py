"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for every node of the links (a, b), the smallest node it is connected to; roots stand for themselves.

    Each round hangs every node's larger neighbours, then its smaller ones, under the least of them, until nothing
    changes: the number of rounds grows with the logarithm of the longest path. A round's links are written to the
    shared folder and read again, and only two numbers of them come to the driver. Links that need more rounds are an error.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for k in range(most_rounds + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        if k == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(under, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
