"""Queries of the dynamic programmes: kernels applied to pairs, utterances and conversations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import kernels as K
from spanloom.operators import edits, joint, matcher, spans, tokens
from spanloom.operators.deal import dealt
from spanloom.plans.relations import normal, split
from spanloom.sources.tables import frames, read, verses

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLANK = 63
#: Conversations whose words are held at once.
TEXTS = 100


def query(f):
    QUERIES[f.__name__] = f
    return f


def query_sql(sql: str):
    def keep(f):
        SQL[f.__name__] = sql
        return query(f)

    return keep


def adjacent(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, reference, hypothesis: each turn and the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: T.words(T.normalize(c))
    c = read(spark, d, "conversations").withColumn("next", F.lead("text").over(w)).where("next is not null")
    return dealt(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), words(F.col("text")).alias("reference"), words(F.col("next")).alias("hypothesis")), "pair_id")


@query
def alignment_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = K.alignments(adjacent(spark, d))
    return a.select("pair_id", "match", "near", "mismatch", "missing", "extra", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), T.verdict(F.col("f1")).alias("verdict"))


@query
def needleman_wunsch(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each alignment."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, *r) for p, a, b in zip(pdf["pair_id"], pdf["reference"], pdf["hypothesis"], strict=True) for k, r in enumerate(K.align(list(a), list(b)))]
            yield pd.DataFrame(rows, columns=["pair_id", "at", "status", "reference", "hypothesis", "score"])

    return adjacent(spark, d).mapInPandas(run, "pair_id long, at int, status string, reference string, hypothesis string, score double").withColumn("score", F.round("score", 6))


@query
def word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return K.word_error_rates(adjacent(spark, d)).withColumn("rate", F.round("rate", 6))


def utterances(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, rows of scores in order: bounded groups of frames."""
    f = frames(spark, d).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("t", "scores"))).alias("f"))
    return dealt(f.select("utt_id", F.transform("f", lambda x: x["scores"]).alias("scores")), "utt_id")


def candidates() -> list[list[int]]:
    """Token sequences to score: a fixed set, shared by all utterances."""
    return [[(7 * k + 3 * j) % BLANK for j in range(1 + k % 6)] for k in range(12)]


WORDS_READ = [[5], [9, 12], [20], [33, 4, 18]]
#: SQL of frames as log-probabilities: l has utt_id, t from 0 on, frames (how many the utterance has) and logs.
LOGS = """r AS (SELECT vec_id // 20 AS utt_id, vec_id % 20 AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT utt_id, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY utt_id) AS frames, list_transform(v, lambda x: x - ln(list_sum(list_transform(v, lambda y: exp(y))))) AS logs, list_position(v, list_max(v)) - 1 AS best FROM r WINDOW w AS (PARTITION BY utt_id ORDER BY t))"""


def states_sql(sequences: list[list[int]]) -> str:
    """SQL of token sequences by number, with blanks between: q has k, n, and states."""
    rows = ", ".join(f"({k}, {c})" for k, c in enumerate(sequences))
    return f"""c(k, tokens) AS (VALUES {rows}),
q AS (SELECT k, tokens, len(tokens) AS n, list_transform(range(1, 2 * len(tokens) + 2), lambda i: CASE WHEN i % 2 = 1 THEN {BLANK} ELSE tokens[i // 2] END) AS states FROM c)"""


def forward_sql(sequences: list[list[int]]) -> str:
    """SQL of all alignments' summed log-probability: z has utt_id, k, n, frames and total, null if a sequence doesn't fit."""
    skip = "i > 2 AND i % 2 = 0 AND states[i] <> states[i - 2]"
    three = [("a[i]"), ("CASE WHEN i > 1 THEN a[i - 1] ELSE CAST('-inf' AS DOUBLE) END"), (f"CASE WHEN {skip} THEN a[i - 2] ELSE CAST('-inf' AS DOUBLE) END")]
    most = f"greatest({', '.join(three)})"
    total = f"CASE WHEN {most} = CAST('-inf' AS DOUBLE) THEN {most} ELSE {most} + ln({' + '.join(f'exp({x} - {most})' for x in three)}) END"
    return f"""{LOGS},
{states_sql(sequences)},
f AS (
  SELECT utt_id, frames, k, n, states, CAST(0 AS BIGINT) AS t, list_transform(range(1, 2 * n + 2), lambda i: CASE WHEN i <= 2 THEN logs[states[i] + 1] ELSE CAST('-inf' AS DOUBLE) END) AS a FROM l CROSS JOIN q WHERE t = 0 AND n > 0 AND 2 * n + 1 <= frames
  UNION ALL
  SELECT utt_id, frames, k, n, states, t2, list_transform(range(1, 2 * n + 2), lambda i: logs[states[i] + 1] + {total})
  FROM (SELECT f.utt_id, f.frames, f.k, f.n, f.states, f.a, l.t AS t2, l.logs FROM f JOIN l ON l.utt_id = f.utt_id AND l.t = f.t + 1) x),
u AS (SELECT DISTINCT utt_id, frames FROM l),
z AS (SELECT u.utt_id, q.k, q.n, u.frames, CASE WHEN greatest(a[-1], a[-2]) = CAST('-inf' AS DOUBLE) THEN NULL ELSE greatest(a[-1], a[-2]) + ln(1 + exp(least(a[-1], a[-2]) - greatest(a[-1], a[-2]))) END AS total
  FROM u CROSS JOIN q LEFT JOIN f ON f.utt_id = u.utt_id AND f.k = q.k AND f.t = u.frames - 1)"""


def best_way_sql(sequences: list[list[int]]) -> str:
    """SQL of the best alignment: z has utt_id, k, n, tokens and way (the state of each frame) of the sequences that fit."""
    one, two = "CASE WHEN i > 1 THEN a[i - 1] ELSE CAST('-inf' AS DOUBLE) END", "CASE WHEN i > 2 AND i % 2 = 0 AND states[i] <> states[i - 2] THEN a[i - 2] ELSE CAST('-inf' AS DOUBLE) END"
    return f"""{LOGS},
{states_sql(sequences)},
f AS (
  SELECT utt_id, frames, k, n, tokens, states, CAST(0 AS BIGINT) AS t, list_transform(range(1, 2 * n + 2), lambda i: CASE WHEN i <= 2 THEN logs[states[i] + 1] ELSE CAST('-inf' AS DOUBLE) END) AS a, list_transform(range(1, 2 * n + 2), lambda i: [i]) AS ways FROM l CROSS JOIN q WHERE t = 0 AND n > 0 AND 2 * n + 1 <= frames
  UNION ALL
  SELECT utt_id, frames, k, n, tokens, states, t2, list_transform(range(1, 2 * n + 2), lambda i: logs[states[i] + 1] + greatest(a[i], {one}, {two})), list_transform(range(1, 2 * n + 2), lambda i: list_append(CASE WHEN a[i] >= {one} AND a[i] >= {two} THEN ways[i] WHEN {one} >= {two} THEN ways[i - 1] ELSE ways[i - 2] END, i))
  FROM (SELECT f.utt_id, f.frames, f.k, f.n, f.tokens, f.states, f.a, f.ways, l.t AS t2, l.logs FROM f JOIN l ON l.utt_id = f.utt_id AND l.t = f.t + 1) x),
z AS (SELECT utt_id, k, n, tokens, CASE WHEN a[-1] >= a[-2] THEN ways[-1] ELSE ways[-2] END AS way FROM f WHERE t = frames - 1)"""


def logs(scores) -> np.ndarray:
    """Frame scores as log-probabilities."""
    m = np.stack(scores).astype(np.float64)
    return m - np.log(np.exp(m).sum(axis=1, keepdims=True))


@query_sql(f"""WITH RECURSIVE {forward_sql([*candidates(), *(c[2:] for c in candidates() if c[:2] == [7, 10] and len(c) > 2)])},
s AS (SELECT utt_id, k, coalesce(-total / frames, 1e9) AS score FROM z),
short(k, of) AS (VALUES {", ".join(f"({len(candidates()) + i}, {k})" for i, k in enumerate(k for k, c in enumerate(candidates()) if c[:2] == [7, 10] and len(c) > 2))})
SELECT s.utt_id, CAST(s.k AS INTEGER) AS candidate, round(s.score, 6) AS score, round(least(s.score, coalesce(x.score, s.score)), 6) AS tolerant
FROM s LEFT JOIN short ON short.of = s.k LEFT JOIN s x ON x.utt_id = s.utt_id AND x.k = short.k WHERE s.k < {len(candidates())}""")
def ctc_score(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, candidate, score, tolerant: every utterance's evidence is read once for all candidates."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, s in zip(pdf["utt_id"], pdf["scores"], strict=True):
                m = logs(s)
                every = candidates()
                rows += [(u, k, *x) for k, x in enumerate(zip(K.ctc_scores(m, every, BLANK), K.tolerant_scores(m, every, BLANK, [7, 10]), strict=True))]
            yield pd.DataFrame(rows, columns=["utt_id", "candidate", "score", "tolerant"])

    out = utterances(spark, d).mapInPandas(run, "utt_id long, candidate int, score double, tolerant double")
    return out.select("utt_id", "candidate", F.round("score", 6).alias("score"), F.round("tolerant", 6).alias("tolerant"))


@query_sql(f"""WITH RECURSIVE {best_way_sql(candidates())},
o AS (SELECT utt_id, k, unnest(range(0, n)) AS ordinal, tokens, way FROM z WHERE list_bool_and(list_transform(range(1, n + 1), lambda j: list_contains(way, 2 * j))))
SELECT utt_id, CAST(k AS INTEGER) AS candidate, CAST(ordinal AS INTEGER) AS ordinal, CAST(tokens[ordinal + 1] AS INTEGER) AS token, CAST(list_position(way, 2 * ordinal + 2) - 1 AS INTEGER) AS first,
       CAST(len(way) - list_position(list_reverse(way), 2 * ordinal + 2) AS INTEGER) AS last FROM o""")
def ctc_align(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, candidate, token, first, last, read: frames of each token, and words read up to the last content frame."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, s in zip(pdf["utt_id"], pdf["scores"], strict=True):
                m = logs(s)
                for k, c in enumerate(candidates()):
                    for j, (a, b) in enumerate(K.ctc_align(m, c, BLANK) or []):
                        rows.append((u, k, j, c[j], a, b))
            yield pd.DataFrame(rows, columns=["utt_id", "candidate", "ordinal", "token", "first", "last"])

    return utterances(spark, d).mapInPandas(run, "utt_id long, candidate int, ordinal int, token int, first int, last int")


@query_sql(f"""WITH RECURSIVE {forward_sql([[t for w in WORDS_READ[: k + 1] for t in w] for k in range(len(WORDS_READ))])},
s AS (SELECT utt_id, k, coalesce(-total / n, 1e9) AS score FROM z)
SELECT utt_id, CAST(coalesce(max(k + 1) FILTER (score <= least + 0.35 AND least < 1e9), 0) AS INTEGER) AS words FROM (SELECT *, min(score) OVER (PARTITION BY utt_id) AS least FROM s) m GROUP BY utt_id""")
def words_read(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, words: how far into a fixed sequence of words an utterance has come, by prefix scores."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"utt_id": pdf["utt_id"], "words": [K.words_read(logs(s), WORDS_READ, BLANK) for s in pdf["scores"]]})

    return utterances(spark, d).mapInPandas(run, "utt_id long, words int")


@query_sql(f"""WITH RECURSIVE {best_way_sql([[t for w in WORDS_READ for t in w]])},
content AS (SELECT utt_id, max(t) FILTER (best <> {BLANK}) AS held FROM l GROUP BY utt_id),
p AS (SELECT utt_id, list_transform(range(1, n + 1), lambda j: list_position(way, 2 * j) - 1) AS first, list_transform(range(1, n + 1), lambda j: len(way) - list_position(list_reverse(way), 2 * j)) AS last FROM z
  WHERE list_bool_and(list_transform(range(1, n + 1), lambda j: list_contains(way, 2 * j)))),
e AS (SELECT content.utt_id, held, last, len(list_filter({[1 + sum(map(len, WORDS_READ[:k])) for k in range(len(WORDS_READ))]}, lambda i: first[i] <= held)) AS read FROM content LEFT JOIN p USING (utt_id))
SELECT e.utt_id, CAST(CASE WHEN last IS NULL THEN b.words WHEN held IS NULL THEN 0 ELSE read END AS INTEGER) AS words,
       CAST(CASE WHEN last IS NULL OR held IS NULL OR read = 0 THEN -1 ELSE last[{[sum(map(len, WORDS_READ[: k + 1])) for k in range(len(WORDS_READ))]}[read]] END AS INTEGER) AS frame
FROM e JOIN ({SQL["words_read"]}) b USING (utt_id)""")
def word_progress(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, words, frame: how far into a fixed sequence of words an utterance has come, by its best path."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [K.progress(logs(s), WORDS_READ, BLANK) for s in pdf["scores"]]
            yield pd.DataFrame({"utt_id": pdf["utt_id"], "words": [f[0] for f in found], "frame": [f[1] for f in found]})

    return utterances(spark, d).mapInPandas(run, "utt_id long, words int, frame int")


@query
def letter_progress(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, word: in which word of a turn its own first half, and a word of the next turn, are last heard."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            verses = [list(a) for a in pdf["reference"]]
            rows = edits.heard_up_to(["".join(a[: len(a) // 2]) + "".join(list(b)[:1]) for a, b in zip(verses, pdf["hypothesis"], strict=True)], verses)
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "word": rows})

    return adjacent(spark, d).mapInPandas(run, "pair_id long, word int")


@query
def tokenizer_min_token(spark: SparkSession, d: str) -> DataFrame:
    """word, tokens, greedy, round_trip: distinct words split into the fewest pieces of a fixed vocabulary."""
    known = {a + b for a in "aeiounrstdlh" for b in "aeiounrstdlh"} | set("abcdefghijklmnopqrstuvwxyz") | {"the", "ing", "tion", "and", "ble", "ver", "ment", "ción"}
    distinct = verses(spark, d).select(F.explode(T.words(F.lower(T.normalize(F.col("text"))))).alias("word")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            least = [K.fewest_tokens(w, known) for w in pdf["word"]]
            greedy = [K.longest_tokens(w, known) for w in pdf["word"]]
            yield pd.DataFrame({"word": pdf["word"], "tokens": [len(t) if t else None for t in least], "greedy": [len(g) for g in greedy], "round_trip": [t is not None and "".join(t) == w for t, w in zip(least, pdf["word"], strict=True)]}).astype({"tokens": "Int32"})

    return distinct.mapInPandas(run, "word string, tokens int, greedy int, round_trip boolean")


@query
def token_table(spark: SparkSession, d: str) -> DataFrame:
    """chapter, first, last, n, digest: spans of up to four verses in tokens of single letters and pairs of them."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    pieces = ["<unk>", "\u2581", *letters, *("\u2581" + x for x in letters), *(x + y for x in "aeioust" for y in "nrstld")]
    vocabulary = spark.createDataFrame(list(enumerate(pieces)), "token_id int, token_text string")
    v = verses(spark, d).withColumn("text", F.lower("text"))
    found = tokens.token_table(tokens.encoded(v, vocabulary), 4)
    return found.select("chapter", "first", "last", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", ",")).alias("digest"))


@query_sql(f"""WITH RECURSIVE t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1),
w AS (SELECT conv_id, {split("text")} AS w FROM t),
l AS (SELECT conv_id, unnest(range(1, len(w) + 1, 5)) AS i, w FROM w WHERE len(w) > 0),
n AS (SELECT conv_id, (i + 4) // 5 AS k, list_slice(w, i, i + 11) AS new FROM l),
f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS tail, 0 AS words, '' AS text FROM n
  UNION ALL
  SELECT conv_id, k2, list_slice(list_concat(tail, new[same + 1:]), -80, -1), CAST(words + len(new) - same AS INTEGER), CASE WHEN len(new) = same THEN text WHEN text = '' THEN array_to_string(new[same + 1:], ' ') ELSE text || ' ' || array_to_string(new[same + 1:], ' ') END
  FROM (SELECT f.*, n.k AS k2, n.new, coalesce(list_max(list_filter(range(1, least(len(n.new), 80, len(f.tail)) + 1), lambda i: (i >= 2 OR i = len(n.new)) AND list_slice(f.tail, -i, -1) = n.new[1:i])), 0) AS same
    FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1) a)
SELECT conv_id, words, md5(text) AS digest FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""")
def stitch_overlap(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, words, digest: sliding windows of 12 words of a conversation, 5 on, put together again."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    w = c.select("conv_id", T.words(T.normalize(F.array_join(F.transform("t", lambda x: x["text"]), " "))).alias("w")).where(F.size("w") > 0)
    windows = w.select("conv_id", F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(5)), lambda i: F.array_join(F.slice("w", i, 12), " ")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out = [K.stitch(w) for w in part.column("windows").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("conv_id").cast(pa.int64()), pa.array([len(x) for x in out], pa.int32()), pa.array([" ".join(x) for x in out], pa.string())], names=["conv_id", "words", "text"])

    return windows.mapInArrow(run, "conv_id long, words int, text string").select("conv_id", "words", F.md5("text").alias("digest"))


@query
def follow_words(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, at, found: how far each turn follows the one before, with a look ahead of five words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [K.follow_words(list(b), list(a)) for a, b in zip(pdf["reference"], pdf["hypothesis"], strict=True)]
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "at": [x[0] for x in out], "found": [len(x[1]) for x in out]})

    return adjacent(spark, d).mapInPandas(run, "pair_id long, at int, found int")


#: Pieces of DuckDB SQL for the similarities of two columns. Its edit distance counts bytes, so the texts are ASCII.
RATIO = "CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 1.0 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"
SUM_RATIO = "CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE CAST(length({a}) + length({b}) - levenshtein({a}, {b}) AS DOUBLE) / (length({a}) + length({b})) END"
WINDOW = "substr(l, CAST(i + 1 AS BIGINT), length(s))"


@query_sql(f"""WITH p AS (SELECT p_partkey, p_brand, concat(p_name, ' ', p_type) AS a, lead(concat(p_type, ' ', p_name, ' ', p_brand)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
w AS (SELECT p_partkey, a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM p WHERE b IS NOT NULL),
f AS (SELECT *, list_max(list_transform(range(0, length(l) - length(s) + 1, greatest(length(s) // 4, 1)), lambda i: {RATIO.format(a="s", b=WINDOW)})) AS fragment,
  list_max(list_transform(range(0, length(l) - length(s) + 1), lambda i: {SUM_RATIO.format(a="s", b=WINDOW)})) AS partial FROM w)
SELECT p_partkey, round({RATIO.format(a="a", b="b")}, 6) AS ratio, round({SUM_RATIO.format(a="a", b="b")}, 6) AS sum_ratio, round(fragment, 6) AS fragment, round(partial, 6) AS partial, round(0.55 * ({RATIO.format(a="a", b="b")}) + 0.45 * fragment, 6) AS text FROM f""")
def fragment_similarity(spark: SparkSession, d: str) -> DataFrame:
    """p_partkey and the similarities of a part's name with the next one's of its brand: whole, windowed, and both."""
    after = F.lead(F.concat_ws(" ", "p_type", "p_name", "p_brand")).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("a"), "p_type", "p_name").withColumn("b", after).where("b is not null")
    a, b = F.col("a"), F.col("b")
    return dealt(p, "p_partkey").select("p_partkey", *(F.round(x, 6).alias(n) for n, x in (("ratio", T.ratio(a, b)), ("sum_ratio", T.sum_ratio(a, b)), ("fragment", T.fragment_score(a, b)), ("partial", T.partial_ratio(a, b)), ("text", T.text_score(a, b)))))


@query
def turn_similarity(spark: SparkSession, d: str) -> DataFrame:
    """pair_id and the similarities of whole turns with the next: windows of one in the other, and both measures together."""
    p = adjacent(spark, d).select("pair_id", F.array_join("reference", " ").alias("a"), F.array_join("hypothesis", " ").alias("b"))
    a, b = F.col("a"), F.col("b")
    kinds = (("whole", edits.similarity), ("fragment", edits.fragment_similarity), ("partial", edits.partial_similarity), ("text", edits.text_similarity))
    return dealt(p, "pair_id").select("pair_id", *(F.round(f(a, b), 6).alias(n) for n, f in kinds))


@query
def nearest_fragments(spark: SparkSession, d: str) -> DataFrame:
    """pair_id and two similarities of whole turns with the next: semi-global edits, and the common subsequence."""
    text = lambda c: F.array_join(c, " ")
    p = adjacent(spark, d).select("pair_id", text("reference").alias("a"), text("hypothesis").alias("b")).where("a <> '' and b <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf["a"], pdf["b"], strict=True))
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "nearest": [K.nearest_fragment(a, b) for a, b in pairs], "shared": [K.shared_subsequence(a, b) for a, b in pairs]})

    return p.mapInPandas(run, "pair_id long, nearest double, shared double").select("pair_id", F.round("nearest", 6).alias("nearest"), F.round("shared", 6).alias("shared"))


@query
def best_path(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, path: for the cycles of a conversation (its turns), each with up to five scored refs, the refs of the best path.

    Of a longer conversation the last 80 cycles count: the reference lets the oldest one go.
    """
    c = read(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 80")
    options = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.concat_ws(":", (F.col("conv_id") % 114 + F.when(k == 4, 1).otherwise(0)).cast("string"), (F.col("turn") + k).cast("string")).alias("ref"), F.round((F.abs(F.xxhash64("text", k)) % 1000) / 1000.0, 3).alias("score")))
    cycles = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", options.alias("o")))).alias("cycles")).select("conv_id", F.to_json("cycles").alias("cycles"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [K.best_path([[(o["ref"], o["score"]) for o in x["o"]] for x in json.loads(j)], K.transition) for j in pdf["cycles"]]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "path": [",".join(p) for p in paths]})

    return cycles.mapInPandas(run, "conv_id long, path string")


@query_sql("""WITH b AS (SELECT conv_id, turn, role, hex(encode(coalesce(text, ''))) AS h FROM conversations),
f AS (SELECT *, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, len(h), 2), lambda i: CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) AS HUGEINT))),
  lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616) AS fnv FROM b)
SELECT conv_id, turn, concat_ws('|', lower(printf('%016x', CAST(fnv AS UBIGINT))), role, '1') AS cache_key FROM f""")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, cache_key: FNV-1a of the text, in a key of several parts."""
    @F.pandas_udf("string")
    def fnv(s: pd.Series) -> pd.Series:
        return s.map(K.fnv64)

    return read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("|", fnv(F.coalesce("text", F.lit(""))), F.col("role"), F.lit("1")).alias("cache_key"))


@query
def span_alignment(spark: SparkSession, d: str) -> DataFrame:
    """chapter, first, last and measures: spans of up to three verses against the chapter's second verse."""
    v = verses(spark, d)
    second = v.where("verse = 1").select("chapter", T.words(T.normalize(F.col("text"))).alias("hypothesis"))
    pairs = spans.spans(v, 3).join(second, "chapter").select("chapter", F.floor(F.col("first") / 8).alias("part"), F.concat_ws(":", *(F.col(c).cast("string") for c in ("chapter", "first", "last"))).alias("pair_id"), T.words(T.normalize(F.col("text"))).alias("reference"), "hypothesis")
    # spans that begin nearby share words and a hypothesis, and are aligned together
    return K.alignments(dealt(pairs, "chapter", "part")).select("pair_id", "match", "missing", "extra", F.round("f1", 6).alias("f1"))


def asked_passages(spark: SparkSession, d: str) -> DataFrame:
    """text_id, text: the stated set of texts to look for, every passage of the benchmark, over all cores."""
    return dealt(read(spark, d, "benchmark").select(F.col("item_id").alias("text_id"), "text"), "text_id")


@query
def joint_match(spark: SparkSession, d: str) -> DataFrame:
    """Every passage, looked for among all verses and the spans of the leading chapters."""
    found = joint.champion(joint.joint(asked_passages(spark, d), verses(spark, d)))
    return found.withColumn("score", F.round("score", 6))


@query
def joint_best(spark: SparkSession, d: str) -> DataFrame:
    """The same with rescues."""
    return joint.best_joint(asked_passages(spark, d), verses(spark, d)).withColumn("score", F.round("score", 6))


@query
def retrieve_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The verses and spans for every passage; the one before it hints at the verses that may follow."""
    v = verses(spark, d)
    chapters = v.groupBy("chapter").agg(F.min("verse").alias("verse")).withColumn("text_id", F.col("chapter").cast("long"))
    hints = asked_passages(spark, d).select("text_id").join(chapters, "text_id").select("text_id", "chapter", "verse")
    return joint.retrieve(asked_passages(spark, d), v, hints).select("text_id", "kind", "chapter", "first", "last", F.round("bonus", 6).alias("bonus"), F.round("score", 6).alias("score"), "rank")


@query
def retrieved_best(spark: SparkSession, d: str) -> DataFrame:
    return joint.best_retrieved(joint.retrieve(asked_passages(spark, d), verses(spark, d), longest=3, singles=5, chapters=20, wide=64)).select("text_id", "kind", "chapter", "first", "last", F.round("score", 6).alias("score"))


#: SQL that gives every character of a column's texts an ASCII one of its own, since DuckDB's edit distance counts bytes; for up to 127 different characters.
LETTERS = "letters AS (SELECT string_agg(c, '' ORDER BY c) AS these, string_agg(chr(CAST(n AS INTEGER)), '' ORDER BY c) AS those FROM (SELECT c, row_number() OVER (ORDER BY c) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM every) x WHERE c <> '') y)"


@query_sql(f"""WITH q AS (SELECT item_id AS text_id, {normal("text")} AS text FROM benchmark), v AS (SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse, {normal("text")} AS text FROM conversations),
every AS (SELECT text FROM q UNION ALL SELECT text FROM v), {LETTERS},
a AS (SELECT text_id, translate(text, these, those) AS a FROM q, letters WHERE text <> ''), b AS (SELECT chapter, verse, translate(text, these, those) AS b FROM v, letters WHERE text <> ''),
s AS (SELECT text_id, chapter, verse, 1 - levenshtein(a, b) / CAST(length(a) + length(b) AS DOUBLE) AS score FROM a CROSS JOIN b)
SELECT text_id, chapter, verse, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY text_id ORDER BY score DESC, chapter, verse) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def search_verses(spark: SparkSession, d: str) -> DataFrame:
    """The five verses most similar to each passage, of all verses."""
    return joint.search(asked_passages(spark, d), verses(spark, d)).withColumn("score", F.round("score", 6))


def token_of(word):
    return F.pmod(F.crc32(word.cast("binary")), F.lit(BLANK)).cast("int")


def heard_corpus(spark: SparkSession, d: str) -> DataFrame:
    """chapter, verse, text: all verses, and every passage as a chapter of its own."""
    own = read(spark, d, "benchmark").select((F.col("item_id") + 1_000_000).cast("int").alias("chapter"), F.lit(1).alias("verse"), "text")
    return verses(spark, d).unionByName(own)


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, text, scores: every passage as it would be heard, of every third one without its last three words; frames that name a token a word, between blanks."""
    v = asked_passages(spark, d).select(F.col("text_id").alias("utt_id"), T.words(T.normalize(F.col("text"))).alias("w"))
    cut = (F.col("utt_id") % 3 == 2) & (F.size("w") > 6)
    said = v.withColumn("w", F.when(cut, F.slice("w", F.lit(1), F.greatest(F.size("w") - 3, F.lit(0)))).otherwise(F.col("w")))
    frame = lambda token: F.transform(F.sequence(F.lit(0), F.lit(BLANK)), lambda k: F.when(k == token, F.lit(-0.01)).otherwise(F.lit(-14.0)).cast("float"))
    blanks = F.array_repeat(frame(F.lit(BLANK)), 8)
    scores = F.concat(F.array(frame(F.lit(BLANK))), F.flatten(F.transform("w", lambda x: F.array(frame(token_of(x)), frame(F.lit(BLANK))))), blanks)
    return said.select("utt_id", F.array_join("w", " ").alias("text"), scores.alias("scores"))


@query
def match_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The outcome for every passage: status, scope, verses and measures, from words, frames and alignment together."""
    v = heard_corpus(spark, d)
    tokens = lambda some: spans.spans(some.withColumn("text", T.normalize(F.col("text"))), 8).select("chapter", "first", "last", F.transform(T.words(F.col("text")), token_of).alias("tokens"))
    out = matcher.match(fragments(spark, d), v, tokens, BLANK, ["The", "and"], [])
    matched = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["chapter"].cast("string"), m["verse"].cast("string"), F.coalesce(m["word_start"].cast("string"), F.lit("")), F.coalesce(m["word_end"].cast("string"), F.lit("")))), ",")
    return out.select("utt_id", "status", "scope", "ref", matched.alias("matches"), *(F.round(c, 6).alias(c) for c in ("precision", "coverage", "f1", "confidence")), "reason")
