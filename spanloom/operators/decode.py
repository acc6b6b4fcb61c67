"""Frame scores to tokens and words: greedy decoding by windows, tokens to text by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalize

#: The mark that begins a word's first token.
WORD_START = "▁"


def best_token(frames: DataFrame) -> DataFrame:
    """utt_id, t, token: the first of the highest scores in each frame."""
    return frames.select("utt_id", "t", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("token"))


def collapsed(frames: DataFrame, blank: int) -> DataFrame:
    """utt_id, ordinal, token, first, last: runs of one token over successive frames, blanks left out."""
    order = Window.partitionBy("utt_id").orderBy("t")
    marked = best_token(frames).withColumn("new", F.coalesce((F.col("token") != F.lag("token").over(order)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.where(F.col("token") != blank).groupBy("utt_id", "run").agg(F.first("token").alias("token"), F.min("t").alias("first"), F.max("t").alias("last"))
    return held.select("utt_id", (F.row_number().over(Window.partitionBy("utt_id").orderBy("run")) - 1).alias("ordinal"), "token", "first", "last")


def last_content_frame(frames: DataFrame, blank: int) -> DataFrame:
    """utt_id, last: the last frame whose best token isn't the blank, -1 without one."""
    return best_token(frames).groupBy("utt_id").agg(F.coalesce(F.max(F.when(F.col("token") != blank, F.col("t"))), F.lit(-1)).alias("last"))


def blank_id(vocabulary: DataFrame) -> DataFrame:
    """The greatest token id, 0 for an empty vocabulary."""
    return vocabulary.agg(F.coalesce(F.max("token_id"), F.lit(0)).alias("blank_id"))


def tokens_to_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """utt_id, word_no, word, tokens: tokens (utt_id, ordinal, token) as words; markers and unknown tokens are skipped."""
    named = tokens.join(vocabulary.withColumnRenamed("token_id", "token").withColumnRenamed("token_text", "piece"), "token").where(~F.col("piece").startswith("<"))
    order = Window.partitionBy("utt_id").orderBy("ordinal")
    starts = F.col("piece").startswith(WORD_START).cast("int")
    grouped = named.withColumn("word_no", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = grouped.groupBy("utt_id", "word_no").agg(F.array_sort(F.collect_list(F.struct("ordinal", "piece", "token"))).alias("p"))
    text = F.replace(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit(WORD_START), F.lit(""))
    return joined.select("utt_id", "word_no", normalize(text).alias("word"), F.transform("p", lambda x: x["token"]).alias("tokens")).where("word <> ''")


def tokens_to_text(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    words = tokens_to_words(tokens, vocabulary)
    return words.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("w")).select("utt_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))
