"""Language identification with rank-order n-gram profiles.

A profile lists the most frequent letter n-grams of a language, or of a document, by falling count
(ties: by the n-gram's code points). A document goes to the language whose profile is least out of
place: the sum, over the document's n-grams, of how far each one's rank is from its rank in the
language's profile, or the most if it isn't there.

Words are runs of letters in lower case, padded with a space on both sides. Profiles are learned
from at most ``sample`` documents per language (those of the smallest hashes of their id; ids whose hash is
above what about the sample's number lies below are left out before any language is put in order, so
that no task meets a whole language); counts over that sample are added up by Spark. Every document is predicted from its whole text. A null text, or one
without letters, is ``und`` with score 0; so is everything if nothing was learned. Ties go to the
language that sorts first. Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import fold, spread

SAMPLE = 1000
TOP = 400
#: The profiles are sent to all executors; more languages than this aren't learned but refused.
MAX_LANGUAGES = 2000
#: Parts in which a language's n-grams are first put in order.
SHARES = 16
#: A text is in none of the languages if its nearness to all of them is below this; texts of fewer n-grams than ENOUGH tell too little.
LEAST, ENOUGH = 0.1, 20
LETTERS = regex.compile(r"\p{L}+")


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-grams, n from 1 to 3, and their counts; an n-gram is packed into an integer, 21 bits a character."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    inside = c[1:-1] != 32  # no n-gram reaches from one word into the next
    return np.unique(np.concatenate([c[1:-1][inside], two, (two[:-1] << 21 | c[2:])[inside]]), return_counts=True)


def ranked(text: str | None, top: int) -> np.ndarray:
    """The n-grams of a text's profile, most frequent first."""
    grams, counts = counted(text)
    if len(grams) > 4 * top:  # those that may be among the first, ties included
        keep = counts >= np.partition(counts, -top)[-top]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:top]]


def learn(docs: DataFrame, sample: int = SAMPLE, top: int = TOP, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, rank: the profiles. A text counts each n-gram by its share, so that no long text decides alone."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("key"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 53)) / float(1 << 53)
    # so many that fewer than sample of a language remain next to never; one row a language is sent out
    near = known.join(F.broadcast(sizes), "lang").where(place < (sample + 10 * sample**0.5 + 10) / F.col("n")).select("lang", "key").distinct()
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(place, "key"))).where(F.col("n") <= sample).drop("n")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(first), ["key", "lang"])  # at most sample rows a language

    def grams(batches):
        for batch in batches:
            for label, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                g, c = counted(t)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(g)), pa.array(g), pa.array(c * (1 << 20) // c.sum())], names=["lang", "gram", "n"])

    sums = chosen.select("lang", "text").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # first among a share of the language's n-grams, then among what is left of the shares
    ranked_in = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram"))
    shares = sums.withColumn("rank", ranked_in(F.pmod(F.xxhash64("gram"), F.lit(SHARES)))).where(F.col("rank") <= top)
    return shares.withColumn("rank", ranked_in() - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


class Profiles:
    """Profiles as one table: a row for each n-gram, a column for each language; the last row is for all others."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank
        self.top = top

    def nearness(self, mine: np.ndarray) -> np.ndarray:
        """For each language, how much of the greatest distance is missing."""
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        theirs = self.ranks[np.where(self.grams[at] == mine, at, len(self.grams))]
        far = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        return 1.0 - far / (self.top * len(mine))

    def fits(self, text: str | None, least: float) -> bool:
        """Whether a text has letters, and isn't of another language than these, if there are any."""
        mine = ranked(text, self.top)
        return len(mine) > 0 and (not self.langs or len(mine) < ENOUGH or float(self.nearness(mine).max()) >= least)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language; the score is how much of the greatest distance is missing, sharpened by the lead on the next one."""
        mine = ranked(text, self.top)
        if not len(mine) or not self.langs:
            return "und", 0.0
        near = self.nearness(mine)
        best = int(near.argmax())
        total = float(near.sum())
        return self.langs[best], float(near[best] / total) if total > 0 else 0.0


def predict(docs: DataFrame, learned: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(sorted(map(tuple, learned.collect())))  # top rows for each of at most MAX_LANGUAGES

    def run(batches):
        known = Profiles(sent.value, top)  # once a task
        for batch in batches:
            found = [known.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[key, "lang_pred", "score"])

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def known_language(docs: DataFrame, learned: DataFrame, top: int = TOP, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs whose text is in a learned language.

    A text without letters goes; so does one of ENOUGH n-grams or more whose nearness to every profile, from 0 (no n-gram in
    it) to 1 (all at their places), is below least: other scripts and languages. Without profiles, letters alone decide.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sorted(map(tuple, learned.collect())))

    def keep(batches):
        known = Profiles(sent.value, top)
        for batch in batches:
            yield batch.filter(pa.array([known.fits(t, least) for t in batch.column(text).to_pylist()], pa.bool_()))

    return spread(docs).mapInArrow(keep, docs.schema)


def train_fold(doc_id: Column) -> Column:
    """Of three folds, the second is held out."""
    return fold(doc_id, 3) != 1


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents outside the held-out fold."""
    out = predict(docs, learn(docs.where(train_fold(F.col("doc_id")))))
    return out.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
