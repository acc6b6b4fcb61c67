"""The token table of a corpus: every verse in tokens of a fixed vocabulary, and every span of verses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalize, words
from spanloom.operators.decode import WORD_START
from spanloom.operators.kernels import fewest_tokens, longest_tokens

#: A vocabulary is sent to all executors; larger ones are refused.
MAX_VOCABULARY = 100_000


def encoded(verses: DataFrame, vocabulary: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """chapter, verse, tokens, unknown: each verse's words in the fewest tokens (the longest each time for a word that has no full split), and how many characters have none.

    vocabulary is (token_id, token_text); a word begins with the mark WORD_START. Distinct words are split once.
    """
    known = {r["token_text"]: r["token_id"] for r in vocabulary.orderBy("token_id").limit(MAX_VOCABULARY + 1).collect()}
    if len(known) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens")
    sent = verses.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = sent.value
        pieces = set(ids)
        for pdf in batches:
            split = [fewest_tokens(WORD_START + w, pieces) or longest_tokens(WORD_START + w, pieces, unknown) for w in pdf["word"]]
            yield pd.DataFrame({"word": pdf["word"], "ids": [[ids.get(t, ids.get(unknown, 0)) for t in s] for s in split], "missing": [s.count(unknown) for s in split]})

    placed = verses.select("chapter", "verse", F.posexplode_outer(words(normalize(F.col("text")))).alias("at", "word"))
    split = placed.select("word").where("word is not null").distinct().mapInPandas(run, "word string, ids array<int>, missing int")
    joined = placed.join(split, "word", "left").groupBy("chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("w"), F.coalesce(F.sum("missing"), F.lit(0)).alias("unknown"))
    return joined.select("chapter", "verse", F.flatten(F.transform(F.filter("w", lambda x: x["ids"].isNotNull()), lambda x: x["ids"])).alias("tokens"), "unknown")


def token_table(tokens: DataFrame, longest: int) -> DataFrame:
    """chapter, first, last, tokens of every run of up to longest verses without a gap."""
    ahead = F.collect_list(F.struct("verse", "tokens")).over(Window.partitionBy("chapter").orderBy("verse").rowsBetween(0, longest - 1))
    rows = tokens.select("chapter", F.col("verse").alias("first"), ahead.alias("a")).select("chapter", "first", "a", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("n"))
    last = F.element_at("a", F.col("n"))["verse"]
    return rows.where(last == F.col("first") + F.col("n") - 1).select("chapter", "first", last.alias("last"), F.flatten(F.transform(F.slice("a", F.lit(1), F.col("n")), lambda v: v["tokens"])).alias("tokens"))


def uneven(tokens: DataFrame, verses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """chapter, verse, back: verses whose tokens, put together again, aren't their normalised text."""
    named = tokens.select("chapter", "verse", F.posexplode("tokens").alias("at", "token_id")).join(vocabulary, "token_id")
    back = named.groupBy("chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("at", "token_text"))).alias("p"))
    text = F.trim(F.replace(F.array_join(F.transform("p", lambda x: x["token_text"]), ""), F.lit(WORD_START), F.lit(" ")))
    joined = verses.select("chapter", "verse", normalize(F.col("text")).alias("text")).join(back.select("chapter", "verse", text.alias("back")), ["chapter", "verse"], "left")
    return joined.where(F.coalesce("back", F.lit("")) != F.coalesce("text", F.lit(""))).select("chapter", "verse", "back")
