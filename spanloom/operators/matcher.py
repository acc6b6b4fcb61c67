"""Which verses a fragment covers, from its text and its frame scores: recall, spans, CTC scores, alignment, decision.

fragments are (utt_id, text, scores): a transcript and its frames' log-probabilities, an array of arrays. verses are
(chapter, verse, text), span_tokens (chapter, first, last, tokens), or what gives these for some verses. Joins, ranks and choices are plans; only
word counts and the two dynamic programmes run in Python, on tiles or one fragment's bounded candidates at a time. Verses and spans are many: they
meet candidates in sorted joins and are never sent out, however small their files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalize, ref_key, words
from spanloom.operators import kernels, recall
from spanloom.operators.deal import dealt, kept, united


@dataclass(frozen=True)
class MatchConfig:
    """Fixed values of the semantics: how many verses are recalled, how long spans get and what they pay for it, what a match has to show."""

    recalled: int = 32
    longest: int = 8
    penalty: float = 0.1
    kept: int = 1024
    shortlist: int = 192
    balance: float = 0.5
    precision: float = 0.6
    coverage: float = 0.5
    confidence: float = 0.35
    words: int = 2
    band: float = 0.05
    spare_coverage: float = 0.4
    spare_precision: float = 0.3
    spare_text: float = 0.35


#: Fixed value: a fragment that shares words with fewer verses gets every verse.
ENOUGH = 8


def recalled(fragments: DataFrame, verses: DataFrame, c: MatchConfig) -> DataFrame:
    """utt_id, chapter, verse, text_score of the verses that lead by words; every verse for fragments that share words with fewer than eight.

    Verses that share nothing have no score, so of all of them only the first can be among the recalled.
    """
    texts = fragments.select(F.col("utt_id").alias("text_id"), "text")
    references = verses.select(F.struct("chapter", "verse").alias("ref_id"), "text")
    most = max(c.recalled, ENOUGH)
    near = kept(recall.best_of_many(texts, references, most, c.balance).drop("rank"))
    rich = near.groupBy("text_id").agg(F.count("*").alias("_k")).where(F.col("_k") >= ENOUGH).select("text_id")
    first = references.select("ref_id").orderBy("ref_id").limit(most + ENOUGH)
    every = texts.select("text_id").join(rich, "text_id", "left_anti").crossJoin(F.broadcast(first))
    silent = every.join(near, ["text_id", "ref_id"], "left_anti").select("text_id", "ref_id", F.lit(0.0).alias("score"))
    ranked = recall.best(united(near, silent), c.recalled)
    return ranked.select(F.col("text_id").alias("utt_id"), F.col("ref_id.chapter").alias("chapter"), F.col("ref_id.verse").alias("verse"), F.col("score").alias("text_score"))


def scored(fragments: DataFrame, spans: DataFrame, blank: int, opening: list[int]) -> DataFrame:
    """utt_id, chapter, first, last, text_score, acoustic: spans (with tokens) that can be heard in the fragment, by how they fit its frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for utt, frames, found in zip(pdf["utt_id"], pdf["scores"], pdf["spans"], strict=True):
                logs = np.stack([np.asarray(f, np.float64) for f in frames]) if len(frames) else np.zeros((0, blank + 1))
                acoustic = kernels.tolerant_scores(logs, [list(x["tokens"]) for x in found], blank, opening)
                rows += [(utt, x["chapter"], x["first"], x["last"], x["text_score"], s) for x, s in zip(found, acoustic.tolist(), strict=True) if s < kernels.INFEASIBLE]
            yield pd.DataFrame(rows, columns=["utt_id", "chapter", "first", "last", "text_score", "acoustic"])

    kind = fragments.schema["utt_id"].dataType.simpleString()
    # spans that can't fit the frames are left out before the kernel
    fit = spans.join(fragments.select("utt_id", F.size("scores").alias("frames")), "utt_id").where((F.size("tokens") > 0) & ((2 * F.size("tokens") + 1 <= F.col("frames")) | (F.size("tokens") > len(opening))))
    asked = fit.groupBy("utt_id").agg(F.collect_list(F.struct("chapter", "first", "last", "text_score", "tokens")).alias("spans")).join(fragments.select("utt_id", "scores").hint("merge"), "utt_id")
    return dealt(asked.select("utt_id", "scores", "spans"), "utt_id").mapInPandas(run, f"utt_id {kind}, chapter int, first int, last int, text_score double, acoustic double")


def aligned(candidates: DataFrame) -> DataFrame:
    """Adds precision, coverage, f1, agreeing and heard (for each reference word whether it stands against a word) to rows of (utt_id, ref, heard_words, ref_words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for utt, said, found in zip(pdf["utt_id"], pdf["said"], pdf["found"], strict=True):
                for x, way in zip(found, kernels.align_all([list(x["ref_words"]) for x in found], list(said)), strict=True):
                    n = {k: sum(r[0] == k for r in way) for k in ("match", "near", "mismatch", "missing", "extra")}
                    rows.append((utt, x["ref"], *n.values(), [r[0] != "missing" for r in way if r[1] is not None]))
            yield pd.DataFrame(rows, columns=["utt_id", "ref", "match", "near", "mismatch", "missing", "extra", "heard"])

    kind = candidates.schema["utt_id"].dataType.simpleString()
    asked = candidates.groupBy("utt_id").agg(F.first("said").alias("said"), F.collect_list(F.struct("ref", "ref_words")).alias("found"))
    out = dealt(asked, "utt_id").mapInPandas(run, f"utt_id {kind}, ref string, match int, near int, mismatch int, missing int, extra int, heard array<boolean>")
    weight, both = F.col("match") + 0.5 * F.col("near"), F.col("match") + F.col("near") + F.col("mismatch")
    share = lambda n: F.coalesce(F.try_divide(weight, n), F.lit(0.0))
    out = out.withColumns({"precision": share(both + F.col("extra")), "coverage": share(both + F.col("missing")), "agreeing": F.col("match") + F.col("near")})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("coverage"), F.col("precision") + F.col("coverage")), F.lit(0.0)))


def covered(heard: Column, sizes: Column, first: Column) -> Column:
    """array<struct(verse, word_start, word_end)> of the verses with a heard word; both ends are null for a verse heard whole."""
    starts = F.transform(sizes, lambda n, k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    parts = F.zip_with(sizes, starts, lambda n, s: F.slice(heard, s + 1, n))
    part = lambda p, end: F.when(~F.forall(p, lambda x: x), end)
    told = F.transform(parts, lambda p, k: F.struct((first + k).alias("verse"), F.exists(p, lambda x: x).alias("any"), F.size(p).alias("n"), part(p, F.array_position(p, True).cast("int") - 1).alias("word_start"), part(p, F.size(p) - F.array_position(F.reverse(p), True).cast("int")).alias("word_end")))
    return F.transform(F.filter(told, lambda v: v["any"] & (v["n"] > 0)), lambda v, k: F.struct(k.alias("ordinal"), v["verse"].alias("verse"), v["word_start"].alias("word_start"), v["word_end"].alias("word_end")))


def decided(candidates: DataFrame, c: MatchConfig) -> DataFrame:
    """One row a fragment: the choice among its candidates, with kind 0 (viable), 1 (spare) or 2 (none; the row of least sort), margin and confidence.

    Viable ones go by precision bands, then sort; spare ones by coverage. The margin is to the best sort of all other candidates.
    """
    w = Window.partitionBy("utt_id")
    by_sort = w.orderBy("sort", "chapter", "first", "last")
    enough = F.col("agreeing") >= c.words
    kind = F.when((F.col("precision") >= c.precision) & enough, 0).when((F.col("coverage") >= c.spare_coverage) & (F.col("precision") >= c.spare_precision) & (F.col("text_score") >= c.spare_text) & enough, 1).otherwise(2)
    first = F.when(F.col("kind") == 0, -F.round(F.col("precision") / c.band)).when(F.col("kind") == 1, -F.col("coverage")).otherwise(0.0)
    other = F.when(F.row_number().over(by_sort) == 1, F.lead("sort").over(by_sort)).otherwise(F.min("sort").over(w))
    df = candidates.withColumn("kind", kind).withColumn("other", other)
    df = df.withColumn("_n", F.row_number().over(w.orderBy("kind", first, "sort", "chapter", "first", "last"))).where("_n = 1").drop("_n")
    margin, scale = F.col("other") - F.col("sort"), F.abs("sort") * 0.15
    lead = F.when(margin.isNull() | (scale <= 1e-9), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / scale)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("precision") + 0.3 * lead))
    return df.withColumn("margin", F.when(F.col("kind") < 2, margin)).withColumn("confidence", F.when(F.col("kind") < 2, sure).otherwise(0.0)).drop("other")


OUTCOME = "utt_id, asr_text, status, scope, matches, ref, precision, coverage, f1, confidence, margin, text_score, acoustic, reason"


def match(fragments: DataFrame, verses: DataFrame, span_tokens: DataFrame | Callable[[DataFrame], DataFrame], blank: int, opening_words: list[str], opening_tokens: list[int], c: MatchConfig = MatchConfig()) -> DataFrame:
    """One row a fragment, with OUTCOME's columns; measures are null where there is no candidate.

    A fragment without words or frames, of the opening alone, or without a candidate is unmatched. So is one whose candidates
    explain too little of it, with the measures of the one that fits its frames best. Of repeated utt_ids any one counts.
    """
    formula = F.array(*map(F.lit, opening_words)).cast("array<string>")
    asked = fragments.dropDuplicates(["utt_id"]).select("utt_id", normalize(F.coalesce("text", F.lit(""))).alias("text"), "scores").withColumn("said", words(F.col("text")))
    why = F.when(F.size("said") == 0, "no words").when(F.forall("said", lambda x: F.array_contains(formula, x)), "opening alone").when(F.coalesce(F.size("scores"), F.lit(0)) <= 0, "no frames")
    asked = kept(asked.withColumn("why", why))  # read by every step below
    known = verses.select("chapter", "verse", normalize(F.col("text")).alias("text"))
    live = asked.where("why is null")
    begun = kept(recalled(live, known, c).withColumnRenamed("verse", "first"))
    # spans begin at recalled verses, so only these and the next ones are put together
    within = begun.select("chapter", F.explode(F.sequence("first", F.col("first") + c.longest - 1)).alias("verse")).distinct()
    some = verses.join(within.hint("merge"), ["chapter", "verse"], "left_semi")
    worded = some.select("chapter", "verse", words(normalize(F.col("text"))).alias("w"))
    tokens = span_tokens if isinstance(span_tokens, DataFrame) else span_tokens(some)
    spans = begun.join(tokens.where(F.col("last") - F.col("first") < c.longest).hint("merge"), ["chapter", "first"])
    sort = F.col("acoustic") + c.penalty * (F.col("last") - F.col("first"))
    found = scored(live, spans, blank, opening_tokens).withColumn("sort", sort)
    # the candidate of least sort and the next ones, kept in all
    by_sort = Window.partitionBy("utt_id").orderBy("sort", "chapter", "first", "last")
    found = found.withColumn("place", F.row_number().over(by_sort)).where(F.col("place") <= c.kept)
    found = kept(found)  # read twice below, as the aligned rows are
    inside = found.select("utt_id", "chapter", "first", "last", F.explode(F.sequence("first", "last")).alias("verse")).join(worded.hint("merge"), ["chapter", "verse"])
    texts = inside.groupBy("utt_id", "chapter", "first", "last").agg(F.array_sort(F.collect_list(F.struct("verse", "w"))).alias("v")).select("utt_id", "chapter", "first", "last", F.flatten(F.transform("v", lambda x: x["w"])).alias("ref_words"), F.transform("v", lambda x: F.size(x["w"])).alias("sizes"))
    near = found.join(texts.hint("merge"), ["utt_id", "chapter", "first", "last"]).join(live.select("utt_id", "said"), "utt_id")
    far = F.abs(F.size("ref_words") - F.size("said"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("utt_id").orderBy(far, "sort", "chapter", "first", "last"))).where((F.col("_n") <= c.shortlist) | (F.col("place") == 1)).drop("_n")
    near = kept(near.withColumn("ref", ref_key(F.col("chapter"), F.col("first"), F.col("last"))))
    best = decided(near.drop("said").join(aligned(near).hint("merge"), ["utt_id", "ref"]), c)
    seen = covered(F.col("heard"), F.col("sizes"), F.col("first"))
    best = best.withColumn("matches", F.transform(seen, lambda v: F.struct(v["ordinal"].alias("ordinal"), F.col("chapter").alias("chapter"), v["verse"].alias("verse"), v["word_start"].alias("word_start"), v["word_end"].alias("word_end"))))
    whole = F.size(F.filter("matches", lambda v: v["word_start"].isNull()))
    best = best.withColumn("scope", F.when(whole == F.size("matches"), "completeVerses").when(whole == 0, "partialVerse").otherwise("mixed"))
    sure = (F.col("kind") == 0) & (F.col("coverage") >= c.coverage) & (F.col("confidence") >= c.confidence)
    good = (F.col("kind") < 2) & (F.size("matches") > 0)
    status = F.when(~good, "unmatched").when(sure & (F.col("scope") == "completeVerses"), "confirmed").when(sure, "partial").otherwise("candidate")
    reason = F.when(F.col("kind") == 2, "nothing explains the text").when(~good, "no verse is covered").when(sure, F.lit(None)).when(F.col("kind") == 1, "explains too little of the text").otherwise("too little evidence")
    chosen = best.select("utt_id", status.alias("status"), F.when(good, F.col("scope")).otherwise("unknown").alias("scope"), F.when(good, F.col("matches")).otherwise(F.slice("matches", 1, 0)).alias("matches"), "ref", "precision", "coverage", "f1", "confidence", "margin", "text_score", "acoustic", reason.alias("reason"))
    joined = asked.select("utt_id", F.col("text").alias("asr_text"), "why").join(chosen, "utt_id", "left")
    none = F.array().cast(chosen.schema["matches"].dataType)
    told = {"status": F.coalesce("status", F.lit("unmatched")), "scope": F.coalesce("scope", F.lit("unknown")), "matches": F.coalesce("matches", none), "reason": F.when(F.col("status").isNull(), F.coalesce("why", F.lit("no candidate"))).otherwise(F.col("reason"))}
    return joined.withColumns(told).select(*OUTCOME.split(", "))
