"""Verses, their spans and their surroundings: chapter, verse, text in, relations out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from spanloom.functions.text import normalize, words



def ordered() -> WindowSpec:
    return Window.partitionBy("chapter").orderBy("verse")


def spans(verses: DataFrame, longest: int) -> DataFrame:
    """chapter, first, last, text of every run of up to longest verses without a gap, joined by spaces."""
    reach = ordered().rowsBetween(0, longest - 1)
    ahead = verses.select("chapter", F.col("verse").alias("first"), F.collect_list(F.struct("verse", "text")).over(reach).alias("ahead"))
    taken = ahead.select("chapter", "first", "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("n"))
    last = F.element_at("ahead", F.col("n"))["verse"]
    text = F.array_join(F.transform(F.slice("ahead", F.lit(1), F.col("n")), lambda v: v["text"]), " ")
    return taken.where(last == F.col("first") + F.col("n") - 1).select("chapter", "first", last.alias("last"), text.alias("text"))


def runs(verses: DataFrame, longest: int) -> DataFrame:
    """chapter, first, lasts, texts: from every verse on, the verses without a gap, up to longest; all spans that begin there are beginnings of it."""
    reach = ordered().rowsBetween(0, longest - 1)
    ahead = verses.select("chapter", F.col("verse").alias("first"), F.collect_list(F.struct("verse", "text")).over(reach).alias("ahead"))
    # verses ascend, so whatever follows a gap stands too far on
    taken = F.filter("ahead", lambda v, i: v["verse"] == F.col("first") + i)
    return ahead.select("chapter", "first", F.transform(taken, lambda v: v["verse"]).alias("lasts"), F.transform(taken, lambda v: v["text"]).alias("texts"))


def surrounding(verses: DataFrame, around: int = 2) -> DataFrame:
    """chapter, verse, near, is_current: the verses within around of each, where they exist."""
    near = verses.select("chapter", F.col("verse").alias("near"))
    asked = verses.select("chapter", "verse", F.explode(F.sequence(F.col("verse") - around, F.col("verse") + around)).alias("near"))
    return asked.join(near, ["chapter", "near"]).select("chapter", "verse", "near", (F.col("verse") == F.col("near")).alias("is_current"))


def following(verses: DataFrame) -> DataFrame:
    """chapter, verse, next_chapter, next_verse: the next verse, or the next chapter's first; null after the last.

    Chapters are put in order block by block (of a thousand numbers); only the first chapter of every block meets the others' in one place.
    """
    firsts = verses.groupBy("chapter").agg(F.min("verse").alias("first")).withColumn("block", F.floor(F.col("chapter") / 1000))
    here = Window.partitionBy("block").orderBy("chapter")
    heads = firsts.groupBy("block").agg(F.min(F.struct("chapter", "first")).alias("head"))
    heads = heads.select("block", F.lead("head").over(Window.orderBy("block")).alias("head"))
    ahead = F.coalesce(F.lead(F.struct("chapter", "first")).over(here), F.col("head"))
    after = firsts.join(heads, "block").select("chapter", ahead.alias("n")).select("chapter", F.col("n.chapter").alias("c"), F.col("n.first").alias("v"))
    inside = verses.select("chapter", "verse", F.lead("verse").over(ordered()).alias("n"))
    within = F.col("n").isNotNull()
    return inside.join(after, "chapter").select("chapter", "verse", F.when(within, F.col("chapter")).otherwise(F.col("c")).alias("next_chapter"), F.coalesce("n", "v").alias("next_verse"))


def word_offsets(verses: DataFrame) -> DataFrame:
    """chapter, verse, words, offset: words before the verse in its chapter."""
    counted = verses.select("chapter", "verse", F.size(words(normalize(F.col("text")))).alias("words"))
    before = F.sum("words").over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("offset", F.coalesce(before, F.lit(0)))


def covered(verses: DataFrame, heard: DataFrame) -> DataFrame:
    """chapter, verse, ordinal, word_start, word_end: the verses of which words were heard (chapter, word), in order.

    Both bounds are null for a verse heard whole; verses without a heard word are left out.
    """
    placed = verses.select("chapter", "verse", F.posexplode(words(normalize(F.col("text")))).alias("at", "word"))
    hit = placed.join(heard.select("chapter", "word").distinct().withColumn("heard", F.lit(True)), ["chapter", "word"], "left")
    counts = hit.groupBy("chapter", "verse").agg(F.count("*").alias("n"), F.count("heard").alias("hits"), F.min(F.when(F.col("heard"), F.col("at"))).alias("a"), F.max(F.when(F.col("heard"), F.col("at"))).alias("b"))
    part = F.col("hits") < F.col("n")
    return counts.where("hits > 0").select("chapter", "verse", (F.row_number().over(ordered()) - 1).alias("ordinal"), F.when(part, F.col("a")).alias("word_start"), F.when(part, F.col("b")).alias("word_end"))


def opening_split(verses: DataFrame, opening: list[str]) -> DataFrame:
    """chapter, verse, opening_words, body_words, only_opening: the formula apart from what follows it, if anything does."""
    w = words(normalize(F.col("text")))
    formula, n = F.array(*map(F.lit, opening)), len(opening)
    starts = (F.slice(w, 1, n) == formula) & (F.size(w) > n)
    none = F.array().cast("array<string>")
    only = (F.size(w) > 0) & F.forall(w, lambda x: F.array_contains(formula, x))
    return verses.select("chapter", "verse", F.when(starts, formula).otherwise(none).alias("opening_words"), F.when(starts, F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0)))).otherwise(w).alias("body_words"), only.alias("only_opening"))


def hint_bonus(verses: DataFrame, hints: DataFrame, bonuses: tuple[float, ...] = (0.22, 0.12, 0.06)) -> DataFrame:
    """chapter, verse, to_chapter, to_verse, bonus: for each hint (chapter, verse) the next verses, or without any the next chapter's first."""
    table = F.array(*map(F.lit, bonuses))
    aim = verses.select(F.col("chapter").alias("to_chapter"), F.col("verse").alias("to_verse"))
    ahead = hints.select("chapter", "verse", F.posexplode(F.sequence(F.col("verse") + 1, F.col("verse") + len(bonuses))).alias("k", "to_verse"))
    same = ahead.withColumn("to_chapter", F.col("chapter")).join(aim, ["to_chapter", "to_verse"]).select("chapter", "verse", "to_chapter", "to_verse", F.get(table, F.col("k")).alias("bonus"))
    last = hints.join(same.select("chapter", "verse").distinct(), ["chapter", "verse"], "left_anti")
    place = F.row_number().over(Window.partitionBy("to_chapter").orderBy("to_verse")) - 1
    firsts = aim.withColumn("k", place).where(F.col("k") < len(bonuses))
    other = last.withColumn("to_chapter", F.col("chapter") + 1).join(firsts, "to_chapter").select("chapter", "verse", "to_chapter", "to_verse", F.get(table, F.col("k")).alias("bonus"))
    return same.unionByName(other)


def short_verses(verses: DataFrame, most: int = 15) -> DataFrame:
    n = F.size(words(normalize(F.col("text"))))
    return verses.where(n.between(1, most)).select("chapter", "verse", n.alias("words"))


def range_text(verses: DataFrame, ranges: DataFrame) -> DataFrame:
    """chapter, first, last, text of the asked verses in order."""
    asked = ranges.select("chapter", "first", "last", F.explode(F.sequence("first", "last")).alias("verse"))
    joined = asked.join(verses, ["chapter", "verse"]).groupBy("chapter", "first", "last").agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("v"))
    return joined.select("chapter", "first", "last", F.array_join(F.transform("v", lambda x: x["text"]), " ").alias("text"))
