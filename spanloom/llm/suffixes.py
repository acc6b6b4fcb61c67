"""Repeated passages, by a sparse suffix array.

Texts are taken as words (runs of anything but white space). Of the ``WINDOW`` word k-grams from a place on the one of least hash is the
place's anchor; equal words have equal anchors, so a passage of ``least`` words that stands elsewhere has an anchor there too, with as
many equal words before and after. Only suffixes that begin at anchors are kept, and of these only the ones whose first
``least - WINDOW + 1`` words occur twice.

A suffix is a row: the words before its anchor and those after its beginning, as far as a passage can reach (its surroundings). Suffixes with equal
surroundings are one, with a count. The others that begin alike are sorted by their words to the right; for each number of words that
neighbours share there, they are sorted by their words to the left, and neighbours compared again: who shares enough words in sum is a match, and
it reaches as far to the left and right as the words are equal. So no pair is left out, whatever lies between two suffixes in one of the orders.
Longer stretches are made of the matches of all their anchors.

Beginnings with more than ``CROWD`` different surroundings aren't held in a task: each of their passages goes, by the hash of its ``least`` words, to where
Spark adds up who has it. Words are compared by 32 bits of their hashes, first of all by 64 bits of the beginning's.

A document is also compared with itself, apart from the place itself. Null and short texts repeat
nothing. Repeated rows of an id count as copies; rows without an id are left out. Positions count words,
ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import spread, stored

LEAST = 50
K = 8
WINDOW = 32
#: Different surroundings of one beginning that a task holds at once.
CROWD = 20_000
WORD = re.compile(r"\S+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors for a word's characters by place.
PLACES = np.array([(0xD1342543DE82EF95 * (2 * i + 1) ^ 0x2545F4914F6CDD1D) % (1 << 64) | 1 for i in range(128)], np.uint64)


def hashed(text: str | None) -> np.ndarray:
    """A hash of each word."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    c = np.frombuffer(f"{' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.flatnonzero(c == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c))))
    h = np.add.reduceat((c * MIX ^ c * MIX >> np.uint64(31)) * PLACES[place % len(PLACES)], starts)
    return (h ^ h >> np.uint64(32)) * MIX


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h = h * MIX + hashes[i : i + n]
    return (h ^ h >> np.uint64(29)) * MIX


def anchors(hashes: np.ndarray, least: int, window: int, k: int = K) -> np.ndarray:
    """The places of the anchors, each once."""
    n = len(hashes) - least + 1
    if n <= 0:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(rolled(hashes, min(k, least)), window)[:n]
    at = np.concatenate([view[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, n)) for i in range(0, n, 65536)])
    return at[np.flatnonzero(np.append(True, at[1:] != at[:-1]))]


def surroundings(hashes: np.ndarray, at: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the words before it, the nearest first, and those after its beginning, by 32 bits each; zero beyond the text."""
    short = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(window, np.uint32), short, np.zeros(least + 1, np.uint32)])
    before = padded[at[:, None] + window - 1 - np.arange(window - 1)]
    return before, padded[at[:, None] + window + np.arange(least - window + 1, least)]


def placed(hashes: np.ndarray, at: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place a hash of the words that it begins with, one that takes in its surroundings, and these."""
    prefix = rolled(hashes, least - window + 1)[at]
    words = np.concatenate(surroundings(hashes, at, least, window), axis=1)
    return prefix.view(np.int64), mixed(prefix, words).view(np.int64), words


def mixed(start: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = start.copy()
    for column in words.T:
        h = (h ^ column) * MIX
        h ^= h >> np.uint64(29)
    return h


def anchor_rows(docs: DataFrame, least: int, window: int) -> DataFrame:
    """id, at, rest, prefix, around: the anchors of every row, how many words there are from each on (least, if there are more), and hashes of the words they begin with and of their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column("t"):
                hashes = hashed(t.as_py())
                at = anchors(hashes, least, window)
                prefix, around, _ = placed(hashes, at, least, window) if len(at) else (at, at, at)
                found.append((at.astype(np.int32), np.minimum(len(hashes) - at, least).astype(np.int32), prefix, around))
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate([f[i] for f in found]) if found else [], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=["id", "at", "rest", "prefix", "around"])

    return docs.mapInArrow(run, "id long, at int, rest int, prefix long, around long")


def suffixes(rows: DataFrame, least: int, window: int) -> DataFrame:
    """prefix, around, first, crowded, words for rows of id, t and places: the surroundings themselves. Of rows of one id those with other words there give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, places in zip(batch.column("id").to_pylist(), batch.column("t"), batch.column("places").to_pylist(), strict=True):
                hashes = hashed(t.as_py())
                places = [p for p in places if p["at"] + least - window + 1 <= len(hashes)]
                for k in range(0, len(places), 5000):
                    part = places[k : k + 5000]
                    prefix, around, words = placed(hashes, np.array([p["at"] for p in part], np.int64), least, window)
                    good = np.flatnonzero(around == np.array([p["around"] for p in part], np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(prefix[good]), pa.array(around[good]), pa.array([i] * len(good), pa.int64()), pa.array([part[j]["crowded"] for j in good], pa.bool_()), pa.array([words[j].tobytes() for j in good], pa.binary())], names=["prefix", "around", "first", "crowded", "words"])

    return rows.mapInArrow(run, "prefix long, around long, first long, crowded boolean, words binary")


def shared(a: np.ndarray) -> np.ndarray:
    """How many words each row begins with that the row before has too; zeros end a text and are never shared."""
    equal = (a[1:] == a[:-1]) & (a[1:] != 0)
    return np.append(0, np.where(equal.all(axis=1), a.shape[1], equal.argmin(axis=1)))


def compared(prefix: np.ndarray, around: np.ndarray, first: np.ndarray, words: np.ndarray, least: int, window: int) -> pa.RecordBatch:
    """around, before, after, other: what the suffixes of whole groups that begin alike share with others of their group, and the least id there."""
    _, kept = np.unique(around, return_index=True)  # repeated rows of an id tell the same
    prefix, around, first, words = prefix[kept], around[kept], first[kept], words[kept]
    n, half = len(prefix), window - 1
    left, right = words[:, :half], words[:, half:]
    by_right = np.lexsort((*right.T[::-1], prefix))
    prefix, around, first, left, right = prefix[by_right], around[by_right], first[by_right], left[by_right], right[by_right]
    new_group = np.append(True, prefix[1:] != prefix[:-1])
    to_right = np.where(new_group, -1, shared(right))
    rank = np.empty(n, np.int64)
    rank[np.lexsort(left.T[::-1])] = np.arange(n)
    begin, end, other = np.full(n, -1), np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    enough = (right != 0).sum(axis=1)
    for extra in range(half + 1):  # so many words to the right of the beginning, and of the passage the rest to the left
        after, need = least - half + extra, half - extra
        kind = np.cumsum(to_right < extra)
        rows = np.flatnonzero(enough >= extra)
        if len(rows) < 2:
            continue
        order = rows[np.lexsort((rank[rows], kind[rows]))]
        same = np.append(False, kind[order][1:] == kind[order][:-1])
        to_left = np.where(same, shared(left[order]), -1)
        linked = to_left >= need
        if not linked.any():
            continue
        start = np.flatnonzero(~linked)
        size = np.diff(np.append(start, len(order)))
        run = np.repeat(np.arange(len(start)), size)
        hit = np.repeat(size > 1, size)
        ids = first[order]
        low = np.minimum.reduceat(ids, start)
        mine = ids == low[run]
        alone = np.add.reduceat(mine.astype(np.int64), start) == 1
        second = np.minimum.reduceat(np.where(mine, np.iinfo(np.int64).max, ids), start)
        partner = np.where(mine & alone[run], second[run], low[run])
        reach = np.maximum(to_left, np.append(to_left[1:], -1))[hit]
        hit_rows = order[hit]
        begin[hit_rows] = np.maximum(begin[hit_rows], reach)
        end[hit_rows] = np.maximum(end[hit_rows], after)
        other[hit_rows] = np.minimum(other[hit_rows], partner[hit])
    found = end >= 0
    return pa.RecordBatch.from_arrays([pa.array(around[found]), pa.array(begin[found].astype(np.int32)), pa.array(end[found].astype(np.int32)), pa.array(other[found])], names=["around", "before", "after", "other"])


def matched(by_prefix: DataFrame, least: int, window: int) -> DataFrame:
    """around, before, after, other from rows sorted by prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [*(batch.column(c).to_numpy().astype(np.int64) for c in ("prefix", "around", "first")), np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint32).reshape(batch.num_rows, -1)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on in the next batch
            if cut:
                yield compared(*(x[:cut] for x in held), least, window)
                held = [x[cut:] for x in held]
        if held:
            yield compared(*held, least, window)

    return by_prefix.select("prefix", "around", "first", "words").mapInArrow(run, "around long, before int, after int, other long")


def matched_crowds(rows: DataFrame, least: int, window: int) -> DataFrame:
    """The same for beginnings of very many surroundings, passage by passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            half = window - 1
            line = np.concatenate([words[:, :half][:, ::-1], words[:, half:]], axis=1)
            prefix = batch.column("prefix").to_numpy().view(np.uint64)
            for k in range(half + 1):  # a passage that begins k words before the beginning
                part = line[:, half - k : 2 * half - k]
                key = mixed(prefix ^ np.uint64(k * int(MIX) % (1 << 64)), part)
                whole = (part != 0).all(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[whole]), *(batch.column(c).filter(pa.array(whole)) for c in ("around", "first")), pa.array(np.full(int(whole.sum()), k, np.int32))], names=["key", "around", "first", "before"])

    passages = stored(rows.mapInArrow(run, "key long, around long, first long, before int"), "passages")
    least_of = passages.groupBy("key").agg(F.min(F.struct("first", "around")).alias("least"), F.min("around").alias("low"), F.max("around").alias("high")).where("low <> high")
    met = stored(passages.join(least_of.select("key", "least"), "key"), "passage-members")
    mine = F.col("around") == F.col("least.around")
    others = met.where(~mine).select("around", "before", F.col("least.first").alias("other"))
    rest = met.groupBy("key").agg(F.first("least.around").alias("around"), F.first("before").alias("before"), F.min(F.when(~mine, F.col("first"))).alias("other"))
    every = others.unionByName(rest.select("around", "before", "other"))
    return every.groupBy("around").agg(F.max("before").alias("before"), (least - F.min("before")).cast("int").alias("after"), F.min("other").alias("other"))


def repeats(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word_start, word_end, other: maximal stretches made of passages that occur elsewhere, and the smallest key found there."""
    window = min(WINDOW, max(2, least - K - 2))
    half = window - 1
    texts = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null"))
    found = stored(anchor_rows(texts, least, window), "anchors")
    # written, so that joins stand on two exchanges, of which Spark may split the one with a hot beginning
    kinds = stored(found.groupBy("prefix", "around").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")), "surroundings")
    twice = kinds.groupBy("prefix").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1").select("prefix", "kinds")
    known = stored(kinds.join(twice, "prefix"), "beginnings")
    asked = known.where("kinds > 1").select(F.col("first.id").alias("id"), F.struct(F.col("first.at").alias("at"), "around", (F.col("kinds") > CROWD).alias("crowded")).alias("place"))
    rows = stored(suffixes(texts.join(asked.groupBy("id").agg(F.collect_list("place").alias("places")), "id"), least, window), "suffixes")
    few, many = rows.where(~F.col("crowded")), rows.where("crowded")
    matches = matched(few.repartition("prefix").sortWithinPartitions("prefix"), least, window).unionByName(matched_crowds(many, least, window))
    matches = stored(matches.withColumnRenamed("other", "elsewhere"), "matches")
    classes = known.join(matches, "around", "left").where("n > 1 or after is not null").select("around", "first", "n", "before", "after", "elsewhere")
    members = stored(found.join(stored(classes, "classes"), "around"), "members")
    several = F.col("n") > 1
    begin = F.when(several, F.greatest(F.col("at") - half, F.lit(0))).otherwise(F.col("at") - F.col("before"))
    end = F.col("at") + F.when(several, F.col("rest")).otherwise(F.col("after"))
    mine = (F.col("id") == F.col("first.id")) & (F.col("at") == F.col("first.at"))
    spans = members.where(~several | ~mine).select("id", begin.alias("begin"), end.alias("end"), F.least(F.when(several, F.col("first.id")), "elsewhere").alias("other"))
    # of equal surroundings the first has the others' smallest id: its own, if it is there again
    first = members.where(several).groupBy("around").agg(F.count(F.when(mine, 1)).alias("same"), F.min(F.when(~mine, F.col("id"))).alias("second"), F.first(F.when(mine, F.struct("id", begin.alias("begin"), end.alias("end"), "elsewhere")), ignorenulls=True).alias("x"))
    firsts = first.select("x.id", "x.begin", "x.end", F.least(F.when(F.col("same") > 1, F.col("x.id")), "second", "x.elsewhere").alias("other"))
    return merged(spans.union(firsts)).select(F.col("id").alias(key), F.col("begin").alias("word_start"), F.col("end").alias("word_end"), "other")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of an id as one."""
    order = Window.partitionBy("id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0)
    group = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("new", new).withColumn("part", group).groupBy("id", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("other").alias("other"))


def without_repeats(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the repeated passages of documents that have an earlier partner: the copy in the smallest key stays."""
    cut = repeats(docs, least, key, text).where(f"other < {key}").groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("word_start", "word_end"))).alias("_cut"))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, cuts, strict=True):
            if spans is None or t is None:
                out.append(t)
                continue
            places, at, parts = [m.span() for m in WORD.finditer(t)], 0, []
            for s in spans:
                parts.append(t[at : places[s["word_start"]][0]])
                at = places[s["word_end"] - 1][1]
            out.append("".join(parts) + t[at:])
        return pd.Series(out)

    return docs.join(cut, docs[key] == cut["_k"], "left").withColumn(text, kept(text, "_cut")).select(docs.columns)
