"""Dealing rows out before costly work, and cutting lineage where a result is used more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Small tables too go to all cores before a kernel or letter-by-letter comparison: partitions of a set number aren't merged by their size.

    Rows go by a hash of the keys: Spark drops a deal by the keys themselves after a step that has dealt by these, whose partitions it may merge into one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def united(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all, columns by name.

    Spark 4.1 takes a union of tables that are dealt out by one key as dealt out by it, although each may have merged its partitions in its own
    way; what is grouped by that key then sees only part of a group. The session is told not to.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for df in others:
        first = first.unionByName(df)
    return first


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or spark.checkpoint.dir, or a new one for a local session without it."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def in_blocks(df: DataFrame, name: str, parts: int, *keys: str) -> DataFrame:
    """block, and name: the rows as so many arrays, dealt by the hash of keys."""
    block = F.pmod(F.xxhash64(*keys), F.lit(parts))
    return df.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*df.columns)).alias(name))


def tiles(asked: DataFrame, known: DataFrame, size: tuple[int, int], keys: tuple[str, ...], together: int = 4) -> DataFrame | None:
    """asked, known: blocks of about size rows each, every block of a stated query set with every block of rows, a few to a partition; None without any.

    No row meets another outside of a tile, so what is dealt out grows with the number of tiles, and a task holds one at a time. Blocks meet by number
    in a sorted join: a cross join would send one side whole to the driver.
    """
    n, m = -(-asked.count() // size[0]), -(-known.count() // size[1])
    if not n or not m:
        return None
    every = in_blocks(asked, "asked", n, "text_id").select("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("block"))
    pairs = every.join(in_blocks(known, "known", m, *keys).hint("merge"), "block").select("asked", "known")
    return pairs.repartition(max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * m // together)))
