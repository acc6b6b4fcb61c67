"""Small relational choices: first of equals, containment, variants, order of first appearance, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import kernels
from spanloom.operators.deal import dealt


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def expanded(spans: DataFrame) -> DataFrame:
    """A row for each verse of spans (chapter, first, last), with the span's other columns."""
    return spans.withColumn("verse", F.explode(F.sequence("first", "last")))


def contained(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, expected, found, hit: whether all expected refs of a key were seen; null where none is expected."""
    want = expected.select(key, "ref").distinct()
    have = want.join(seen.select(key, "ref").distinct().withColumn("_s", F.lit(1)), [key, "ref"], "left").groupBy(key).agg(F.count("*").alias("expected"), F.count("_s").alias("found"))
    keys = expected.select(key).union(seen.select(key)).distinct()
    return keys.join(have, key, "left").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), (F.col("found") == F.col("expected")).alias("hit"))


def first_seen(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key, value, place: distinct values of a key in the order in which they appear."""
    firsts = rows.groupBy(key, value).agg(F.min(position).alias("_p"))
    return firsts.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy("_p", value)) - 1).alias("place"))


def leading_groups(ranked: DataFrame, key: str, group: str, rank: str, most: int) -> DataFrame:
    """key, group, best: the first groups by their best rank."""
    best = ranked.groupBy(key, group).agg(F.min(rank).alias("best"))
    return best.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("best", group))).where(F.col("_n") <= most).drop("_n")


def variants(rows: DataFrame, opening: list[str], words: str = "words") -> DataFrame:
    """Each row's words whole (variant 0), and without the opening where more follows it (variant 1)."""
    n, formula = len(opening), F.array(*map(F.lit, opening))
    w = F.col(words)
    short = F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0)))
    both = F.when((F.slice(w, 1, n) == formula) & (F.size(w) > n), F.array(w, short)).otherwise(F.array(w))
    return rows.select(*(c for c in rows.columns if c != words), F.posexplode(both).alias("variant", words))


def acoustic_margins(scored: DataFrame, key: str = "text_id") -> DataFrame:
    """Adds how much worse the next row is, by acoustic score (less is better) then prior; 0 for the last."""
    w = Window.partitionBy(key).orderBy("acoustic", F.desc("prior"), "ref_id")
    return scored.withColumn("acoustic_margin", F.coalesce(F.lead("acoustic").over(w) - F.col("acoustic"), F.lit(0.0)))


def fixed_windows(lengths: DataFrame, size: float, count: int = 3) -> DataFrame:
    """key columns, n, start, end: windows evenly placed over a length (seconds); one window if it is shorter."""
    room = F.greatest(F.col("seconds") - size, F.lit(0.0))
    n = F.when(room > 0, F.lit(count)).otherwise(1)
    rows = lengths.withColumn("n", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.when(room > 0, room * F.col("n") / (count - 1)).otherwise(0.0)
    return rows.withColumn("start", F.round(start, 6)).withColumn("end", F.round(F.least(F.col("start") + size, F.col("seconds")), 6))


def sliding_windows(lengths: DataFrame, size: float, hop: float, tail: float | None = None) -> DataFrame:
    """Windows a hop apart that are full, or with tail, partial ones too while they keep that length."""
    least = size if tail is None else tail
    count = F.floor((F.col("seconds") - least) / hop)
    rows = lengths.where(F.col("seconds") >= least).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), count)))
    start = F.col("n") * hop
    return rows.withColumn("start", F.round(start, 6)).withColumn("end", F.round(F.least(start + size, F.col("seconds")), 6))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def ninetieth(n: Column) -> Column:
    return F.floor((n - 1) * 0.9 + 0.5)


def ranked_values(rows: DataFrame, key: str, value: str, **places: Callable[[Column], Column]) -> DataFrame:
    """key and for each place (a number from 0, of the number of values) the value there in ascending order; nulls don't count.

    Values are first counted in classes that follow their order, and only the class that holds a place is put in order, so
    no key's values meet in one task or array.
    """
    known = rows.where(F.col(value).isNotNull()).withColumn("_class", F.floor(F.signum(value) * F.log1p(F.abs(value)) * 512))
    counts = known.groupBy(key, "_class").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(w))
    asked = placed.select(key, "_class", "_n", "_before", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), at(F.col("_all")).cast("long").alias("at")) for n, at in places.items()))).alias("_p"))
    asked = asked.where((F.col("_p.at") >= F.col("_before")) & (F.col("_p.at") < F.col("_before") + F.col("_n"))).select(key, "_class", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_before")).alias("_at"))
    same = known.join(asked.select(key, "_class").distinct(), [key, "_class"], "left_semi").groupBy(key, "_class", value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key, "_class").orderBy(value))
    hit = same.withColumn("_to", upto).join(asked, [key, "_class"]).where((F.col("_at") >= F.col("_to") - F.col("_n")) & (F.col("_at") < F.col("_to")))
    return hit.groupBy(key).agg(*(F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in places))


def pauses(energy: DataFrame, key: str, frame: float = 0.02, share: float = 0.4, least: float = 0.35) -> DataFrame:
    """key, first, last, middle: runs of frames (n, rms) that are quiet for least seconds, against a share of the median."""
    order = Window.partitionBy(key).orderBy("n")
    most = energy.groupBy(key).agg(F.max("rms").alias("_m")).where("_m >= 1e-5")
    level = ranked_values(energy, key, "rms", _e=upper_median).join(most, key, "left_semi").select(key, F.greatest(F.lit(1e-5), F.col("_e") * share).alias("_t"))
    quiet = energy.join(level, key).withColumn("_q", F.col("rms") < F.col("_t"))
    runs = quiet.withColumn("_g", F.col("n") - F.row_number().over(Window.partitionBy(key, "_q").orderBy("n"))).where("_q")
    found = runs.groupBy(key, "_g").agg(F.min("n").alias("first"), F.max("n").alias("last")).where((F.col("last") - F.col("first") + 1) * frame >= least - 1e-9)
    return found.select(key, "first", "last", ((F.col("first") + F.col("last") + 1) / 2 * frame).alias("middle"), F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("place"))


def summary(rows: DataFrame) -> DataFrame:
    """total, matched, in_chapter of rows with status, chapter and expected."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "unmatched").alias("matched"), F.count_if((F.col("status") != "unmatched") & (F.col("chapter") == F.col("expected"))).alias("in_chapter"))


def argmax_agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """agreement: the share of frames (keys, scores) whose best token is the same in both."""
    best = lambda df, n: df.select(*keys, F.array_position("scores", F.array_max("scores")).alias(n))
    return best(left, "a").join(best(right, "b"), keys).agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"))


def preview_stability(previews: DataFrame, key: str, order: str, refs: str) -> DataFrame:
    """Adds rounds (previews in a row with the same refs, 0 without any) and generation (how often the refs have changed) to a session's previews.

    A preview without refs ends the run, so the same refs after it begin anew.
    """
    w = Window.partitionBy(key).orderBy(order)
    same = F.col(refs).eqNullSafe(F.lag(refs).over(w)) & (F.coalesce(refs, F.lit("")) != "")
    runs = previews.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("generation", F.sum("_new").over(w))
    n = F.row_number().over(Window.partitionBy(key, "generation").orderBy(order))
    return runs.withColumn("rounds", F.when(F.coalesce(refs, F.lit("")) == "", 0).otherwise(n)).drop("_new")


def dropped_previews(previews: DataFrame, key: str, order: str, shown: str) -> DataFrame:
    """Of rows with generation: the last of each generation that had something shown when the next one came."""
    w = Window.partitionBy(key).orderBy(order)
    return previews.withColumn("_next", F.lead("generation").over(w)).where((F.col("_next") != F.col("generation")) & F.col(shown)).drop("_next")


def silence_so_far(levels: DataFrame, key: str, order: str, quiet: str, seconds: str) -> DataFrame:
    """Adds still: the seconds of quiet in a row up to each chunk, 0 at a loud one."""
    w = Window.partitionBy(key).orderBy(order)
    runs = levels.withColumn("_run", F.sum(F.when(F.col(quiet), 0).otherwise(1)).over(w))
    still = F.sum(F.when(F.col(quiet), F.col(seconds)).otherwise(0.0)).over(Window.partitionBy(key, "_run").orderBy(order))
    return runs.withColumn("still", still).drop("_run")


def unseen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first emission of every value of a key; repeated ones are dropped, in a row or not."""
    return first_of(rows, [key, value], F.col(order))


def mean_of_first(rows: DataFrame, key: str, value: str, order: str, score: str) -> DataFrame:
    """key, n, confidence: how many values a key has and the mean of their scores where each came first, to two decimals."""
    firsts = unseen(rows, key, value, order)
    return firsts.groupBy(key).agg(F.count("*").alias("n"), (F.floor(F.avg(score) * 100 + 0.5) / 100).alias("confidence"))


def best_variant(rows: DataFrame, key: str, variant: str, score: str) -> DataFrame:
    """The variant of the highest score; the first of equals."""
    return first_of(rows, [key], F.desc(score), F.col(variant))


def weakest(rows: DataFrame, key: str, sort: str, *ties: str) -> DataFrame:
    """The row of least sort, which is shown for what was rejected."""
    return first_of(rows, [key], F.col(sort), *map(F.col, ties))


def head_cut(words: Column, groups: Column) -> Column:
    """struct(words, groups) of one length: more groups than words lose their first ones, more words than groups their last."""
    n, m = F.size(words), F.size(groups)
    return F.struct(F.when(m < n, F.slice(words, F.lit(1), m)).otherwise(words).alias("words"), F.when(m > n, F.slice(groups, m - n + 1, n)).otherwise(groups).alias("groups"))


#: Fixed value: a match whose reference has more than so many times the window's words is inflated.
INFLATED = 1.6


def tuning(outcomes: DataFrame, setting: str = "setting", order: str = "n") -> DataFrame:
    """A row for each setting: windows, match_rate, mean_coverage, inflation_rate, regress_rate, mean_span, mean_verses, spans (span:count, ascending).

    outcomes have (setting, n, first, last, verses, coverage, reference_words, words), first null for windows without a match. A match regresses if it
    begins before the one matched last. Rates are shares of the matches, of regressions of those with one before; 0 without any.
    """
    found = outcomes.where("first is not null").withColumn("_before", F.lag("first").over(Window.partitionBy(setting).orderBy(order))).withColumn("_span", F.col("last") - F.col("first") + 1)
    share = lambda c: F.avg(c.cast("double"))
    inflated, back = F.col("reference_words") > F.col("words") * INFLATED, F.col("first") < F.col("_before")
    told = found.groupBy(setting).agg(F.count("*").alias("_k"), F.avg(F.coalesce("coverage", F.lit(0.0))).alias("mean_coverage"), share(inflated).alias("inflation_rate"), share(back).alias("regress_rate"), share(F.col("_span")).alias("mean_span"), share(F.col("verses")).alias("mean_verses"))
    one = F.concat_ws(":", F.col("_span").cast("string"), F.col("_c").cast("string"))
    seen = found.groupBy(setting, "_span").agg(F.count("*").alias("_c")).groupBy(setting).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_span", one.alias("one")))), lambda x: x["one"]), ",").alias("spans"))
    every = outcomes.groupBy(setting).agg(F.count("*").alias("windows")).join(told, setting, "left").join(seen, setting, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    rate = (F.coalesce("_k", F.lit(0)) / F.col("windows")).alias("match_rate")
    return every.select(setting, "windows", rate, *(zero(c) for c in ("mean_coverage", "inflation_rate", "regress_rate", "mean_span", "mean_verses")), F.coalesce("spans", F.lit("")).alias("spans"))


#: Fixed value: the least F1, precision and recall of a clip that passes.
PASSES = 0.9


def accuracy(words: DataFrame, references: DataFrame) -> DataFrame:
    """clip, f1, precision, recall, rate (word errors), reference_words, hypothesis_words, passed: what was transcribed of every clip against what it should be.

    words are (clip, word, start), references (clip, text). Clips are aligned one by one, in one pass; one of which nothing was heard has no words.
    """
    heard = words.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("start", "word"))).alias("h"))
    pairs = references.join(heard, "clip", "left").select(F.col("clip").alias("pair_id"), T.words(T.normalize(F.col("text"))).alias("reference"), F.coalesce(F.transform("h", lambda x: x["word"]), F.array().cast("array<string>")).alias("hypothesis"))
    every = kernels.compared(dealt(pairs, "pair_id")).select("pair_id", "f1", "precision", "recall", "rate", "reference_words", "hypothesis_words")
    passed = F.least("f1", "precision", "recall") >= PASSES
    return every.withColumn("passed", passed).withColumnRenamed("pair_id", "clip")


def gate(checked: DataFrame) -> DataFrame:
    """passed, total, ok: whether every clip passes; none is no pass."""
    return checked.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total")).withColumn("ok", (F.col("passed") == F.col("total")) & (F.col("total") > 0))
