"""Tables, and the roles they stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a table in one small file is dealt out by rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chapter, verse, text: the turns of conversations."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"), "text")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text")


def frames(spark: SparkSession, sf_dir: str, length: int = 20) -> DataFrame:
    """utt_id, t, scores: vectors as frames of utterances of a fixed length."""
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / length).alias("utt_id"), (F.col("vec_id") % length).cast("int").alias("t"), F.col("embedding").alias("scores"))
