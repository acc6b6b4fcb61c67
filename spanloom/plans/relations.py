"""Queries of the relational operators over the stand-in tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import decode, recall, spans, store
from spanloom.operators.deal import kept
from spanloom.sources.tables import frames, passages, read, spread, transcripts, verses

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: RE2 patterns of the same classes as the Spark expressions'.
MARKS, SPACES = T.MARKS, T.SPACES


def normal(column: str) -> str:
    """SQL of functions.text.normalize, for texts without presentation forms."""
    return f"trim(regexp_replace(translate(regexp_replace({column}, '{MARKS}', '', 'g'), '{T.FOLDED}', '{T.FOLDS}'), '{SPACES}', ' ', 'g'))"


def split(column: str) -> str:
    return f"list_filter(string_split({normal(column)}, ' '), lambda w: w <> '')"


VERSES = "v AS (SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse, text FROM conversations)"
HITS = f"""t AS (SELECT doc_id AS text_id, text, {split("text")} AS w FROM documents),
r AS (SELECT item_id AS ref_id, text, {split("text")} AS w FROM benchmark),
tw AS (SELECT DISTINCT text_id, unnest(w) AS word FROM t), rw AS (SELECT DISTINCT ref_id, unnest(w) AS word FROM r),
tn AS (SELECT text_id, len(list_distinct(w)) AS n, len(w) AS n_all FROM t), rn AS (SELECT ref_id, len(list_distinct(w)) AS m, len(w) AS m_all FROM r),
h AS (SELECT text_id, ref_id, count(*) AS hits FROM tw JOIN rw USING (word) GROUP BY ALL),
scored AS (SELECT text_id, ref_id, hits, round(0.85 * (0.5 * hits / n + 0.5 * hits / m), 9) AS score, n, n_all, m, m_all FROM h JOIN tn USING (text_id) JOIN rn USING (ref_id))"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"SELECT doc_id, md5({normal('text')}) AS digest, CAST(len({split('text')}) AS INTEGER) AS n_words FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalize(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.size(T.words(t)).alias("n_words"))


@query(f"WITH {HITS} SELECT text_id, ref_id, CAST(hits AS BIGINT) AS hits FROM h")
def inverted_index_hits(spark: SparkSession, d: str) -> DataFrame:
    return recall.word_hits(transcripts(spark, d), passages(spark, d))


def ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    scores = recall.leading_scores(transcripts(spark, d), passages(spark, d), k, extra=("n", "n_all", "m"))
    return recall.best(scores.withColumn("score", F.round("score", 9)), k)


RANKED = f"WITH {HITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, ref_id) AS rank FROM scored)"


@query(f"{RANKED} SELECT text_id, ref_id, CAST(hits AS BIGINT) AS hits, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def recall_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, 3).select("text_id", "ref_id", "hits", F.round("score", 6).alias("score"), "rank")


@query()
def recall_with_edits(spark: SparkSession, d: str) -> DataFrame:
    """The three leading passages of every document, letters counted; only passages that the edit term can still bring there are compared."""
    return recall.best_with_edits(transcripts(spark, d), passages(spark, d), 3).select("text_id", "ref_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {HITS}, k AS (SELECT text_id, count(*) AS k FROM h GROUP BY 1)
SELECT t.text_id, r.ref_id, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits
FROM t CROSS JOIN r LEFT JOIN h ON h.text_id = t.text_id AND h.ref_id = r.ref_id LEFT JOIN k ON k.text_id = t.text_id
WHERE h.hits IS NOT NULL OR coalesce(k.k, 0) < 8""")
def recall_sparse_fallback(spark: SparkSession, d: str) -> DataFrame:
    return recall.sparse_fallback(transcripts(spark, d), passages(spark, d)).select("text_id", "ref_id", F.col("hits").cast("long").alias("hits"))


@query(f"""WITH {VERSES} SELECT a.chapter, a.verse AS first, b.verse AS last, md5(string_agg(m.text, ' ' ORDER BY m.verse)) AS digest
FROM v a JOIN v b ON a.chapter = b.chapter AND b.verse BETWEEN a.verse AND a.verse + 3
JOIN v m ON m.chapter = a.chapter AND m.verse BETWEEN a.verse AND b.verse
GROUP BY ALL HAVING count(*) = b.verse - a.verse + 1""")
def span_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return spans.spans(verses(spark, d), 4).select("chapter", "first", "last", F.md5("text").alias("digest"))


@query(f"WITH {VERSES} SELECT a.chapter, a.verse, b.verse AS near, a.verse = b.verse AS is_current FROM v a JOIN v b ON a.chapter = b.chapter AND abs(a.verse - b.verse) <= 2")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return spans.surrounding(verses(spark, d))


@query(f"WITH {VERSES} SELECT chapter, verse, lead(chapter) OVER w AS next_chapter, lead(verse) OVER w AS next_verse FROM v WINDOW w AS (ORDER BY chapter, verse)")
def next_verse(spark: SparkSession, d: str) -> DataFrame:
    return spans.following(verses(spark, d))


@query(f"""WITH {VERSES}, c AS (SELECT chapter, verse, CAST(len({split('text')}) AS INTEGER) AS words FROM v)
SELECT chapter, verse, words, CAST(coalesce(sum(words) OVER (PARTITION BY chapter ORDER BY verse ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c""")
def word_offsets(spark: SparkSession, d: str) -> DataFrame:
    return spans.word_offsets(verses(spark, d))


@query(f"""WITH {VERSES}, p AS (SELECT chapter, verse, unnest({split('text')}) AS word, generate_subscripts({split('text')}, 1) - 1 AS pos FROM v),
heard AS (SELECT DISTINCT chapter, word FROM p WHERE verse % 2 = 0),
c AS (SELECT chapter, verse, count(*) AS n, count(heard.word) AS hits, min(pos) FILTER (heard.word IS NOT NULL) AS a, max(pos) FILTER (heard.word IS NOT NULL) AS b FROM p LEFT JOIN heard USING (chapter, word) GROUP BY ALL)
SELECT chapter, verse, CAST(row_number() OVER (PARTITION BY chapter ORDER BY verse) - 1 AS INTEGER) AS ordinal,
CAST(CASE WHEN hits < n THEN a END AS INTEGER) AS word_start, CAST(CASE WHEN hits < n THEN b END AS INTEGER) AS word_end FROM c WHERE hits > 0""")
def covered_ranges(spark: SparkSession, d: str) -> DataFrame:
    v = verses(spark, d)
    heard = v.where("verse % 2 = 0").select("chapter", F.explode(T.words(T.normalize(F.col("text")))).alias("word"))
    return spans.covered(v, heard)


OPENING = ["The", "and"]


@query(f"""WITH {VERSES}, w AS (SELECT chapter, verse, {split('text')} AS w FROM v)
SELECT chapter, verse, CAST(CASE WHEN len(w) > 2 AND w[1:2] = ['The', 'and'] THEN 2 ELSE 0 END AS INTEGER) AS opening_words,
CAST(CASE WHEN len(w) > 2 AND w[1:2] = ['The', 'and'] THEN len(w) - 2 ELSE len(w) END AS INTEGER) AS body_words,
len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('The', 'and'))) = 0 AS only_opening FROM w""")
def opening_split(spark: SparkSession, d: str) -> DataFrame:
    s = spans.opening_split(verses(spark, d), OPENING)
    return s.select("chapter", "verse", F.size("opening_words").alias("opening_words"), F.size("body_words").alias("body_words"), "only_opening")


@query(f"""WITH {VERSES}, n AS (SELECT chapter, verse, CAST(len({split('text')}) AS INTEGER) AS words FROM v) SELECT * FROM n WHERE words BETWEEN 1 AND 15""")
def short_verses(spark: SparkSession, d: str) -> DataFrame:
    return spans.short_verses(verses(spark, d))


@query(f"""WITH {VERSES}, a AS (SELECT chapter, min(verse) AS first, min(verse) + 2 AS last FROM v GROUP BY 1)
SELECT a.chapter, a.first, a.last, md5(string_agg(v.text, ' ' ORDER BY v.verse)) AS digest FROM a JOIN v ON v.chapter = a.chapter AND v.verse BETWEEN a.first AND a.last GROUP BY ALL""")
def range_text(spark: SparkSession, d: str) -> DataFrame:
    v = verses(spark, d)
    asked = v.groupBy("chapter").agg(F.min("verse").alias("first"), (F.min("verse") + 2).alias("last"))
    return spans.range_text(v, asked).select("chapter", "first", "last", F.md5("text").alias("digest"))


@query(f"""WITH {VERSES}, s AS (SELECT a.chapter, a.verse, b.chapter AS to_chapter, b.verse AS to_verse, [0.22, 0.12, 0.06][b.verse - a.verse] AS bonus FROM v a JOIN v b ON a.chapter = b.chapter AND b.verse - a.verse BETWEEN 1 AND 3),
f AS (SELECT chapter, verse, row_number() OVER (PARTITION BY chapter ORDER BY verse) AS k FROM v),
o AS (SELECT a.chapter, a.verse, f.chapter AS to_chapter, f.verse AS to_verse, [0.22, 0.12, 0.06][f.k] AS bonus FROM v a JOIN f ON f.chapter = a.chapter + 1 AND f.k <= 3 WHERE (a.chapter, a.verse) NOT IN (SELECT (chapter, verse) FROM s))
SELECT chapter, verse, to_chapter, to_verse, CAST(bonus AS DOUBLE) AS bonus FROM s UNION ALL SELECT chapter, verse, to_chapter, to_verse, CAST(bonus AS DOUBLE) FROM o""")
def hint_bonus(spark: SparkSession, d: str) -> DataFrame:
    v = verses(spark, d)
    return spans.hint_bonus(v, v.select("chapter", "verse"))


@query(f"""WITH t AS (SELECT doc_id AS text_id, {normal("text")} AS s FROM documents), r AS (SELECT item_id AS ref_id, {normal("text")} AS s FROM benchmark),
g AS (SELECT DISTINCT text_id, unnest(list_concat(list_transform(range(1, CAST(greatest(length(s), 1) AS BIGINT)), lambda i: substr(s, i, 2)), list_transform(range(1, CAST(greatest(length(s) - 1, 1) AS BIGINT)), lambda i: substr(s, i, 3)))) AS gram FROM t),
q AS (SELECT DISTINCT ref_id, unnest(list_concat(list_transform(range(1, CAST(greatest(length(s), 1) AS BIGINT)), lambda i: substr(s, i, 2)), list_transform(range(1, CAST(greatest(length(s) - 1, 1) AS BIGINT)), lambda i: substr(s, i, 3)))) AS gram FROM r),
j AS (SELECT text_id, ref_id, round(sum(CASE WHEN length(gram) = 2 THEN 1.0 ELSE 0.48 END), 6) AS overlap FROM g JOIN q USING (gram) GROUP BY ALL)
SELECT text_id, ref_id, CAST(overlap AS DOUBLE) AS overlap, CAST(row_number() OVER (PARTITION BY text_id ORDER BY overlap DESC, ref_id) AS INTEGER) AS rank FROM j QUALIFY rank <= 3""")
def ngram_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return recall.gram_overlap(transcripts(spark, d), passages(spark, d), 3)


FRAMES = "f AS (SELECT vec_id // 20 AS utt_id, CAST(vec_id % 20 AS INTEGER) AS t, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS token FROM embeddings)"


@query(f"""WITH {FRAMES}, m AS (SELECT *, CASE WHEN token = lag(token) OVER (PARTITION BY utt_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM f),
g AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY t) AS run FROM m), h AS (SELECT utt_id, run, any_value(token) AS token, min(t) AS first, max(t) AS last FROM g WHERE token <> 63 GROUP BY 1, 2)
SELECT utt_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY run) - 1 AS INTEGER) AS ordinal, token, first, last FROM h""")
def ctc_collapse(spark: SparkSession, d: str) -> DataFrame:
    return decode.collapsed(frames(spark, d), 63)


@query(f"WITH {FRAMES} SELECT utt_id, CAST(coalesce(max(t) FILTER (token <> 63), -1) AS INTEGER) AS last FROM f GROUP BY 1")
def last_content_frame(spark: SparkSession, d: str) -> DataFrame:
    return decode.last_content_frame(frames(spark, d), 63)


@query("SELECT CAST(max(len(embedding)) - 1 AS INTEGER) AS blank_id FROM embeddings")
def vocab_blank_id(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = read(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("token_id"))
    return decode.blank_id(vocabulary)


SORTED = f"{RANKED}, s AS (SELECT text_id, ref_id, hits, n, m, n_all, m_all, round(1 - score, 6) AS sort, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5)"


def sorted_five(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, 5).select("text_id", "ref_id", "hits", F.round(1 - F.col("score"), 6).alias("sort"), "rank", "n", "n_all", "m")


@query(f"""{SORTED}, l AS (SELECT *, lead(sort) OVER (PARTITION BY text_id ORDER BY rank) AS nx FROM s)
SELECT text_id, ref_id, rank, round(coalesce(nx - sort, 0), 6) AS margin, round(CASE WHEN nx IS NULL OR abs(sort) * 0.15 <= 1e-9 THEN 1.0 WHEN nx - sort <= 0 THEN 0.0 ELSE least(1.0, (nx - sort) / (abs(sort) * 0.15)) END, 6) AS confidence FROM l""")
def runner_up_margin(spark: SparkSession, d: str) -> DataFrame:
    m = recall.margins(sorted_five(spark, d))
    return m.select("text_id", "ref_id", "rank", F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"))


@query(f"""{SORTED}, e AS (SELECT *, hits >= 3 AS feasible, min(sort) FILTER (hits >= 3) OVER (PARTITION BY text_id) AS lo, max(sort) FILTER (hits >= 3) OVER (PARTITION BY text_id) AS hi, CAST(hits AS DOUBLE) / n AS tx, n <= 18 AS weak, 1.0 / rank AS prior FROM s),
k AS (SELECT *, CASE WHEN feasible THEN 1 - (sort - lo) / greatest(hi - lo, 1e-6) ELSE 0.0 END AS ev FROM e),
z AS (SELECT text_id, ref_id, round(CASE WHEN weak THEN 0.45 * ev + 0.40 * tx ELSE 0.60 * ev + 0.25 * tx END + 0.15 * prior, 6) AS fusion FROM k) SELECT * FROM z""")
def fusion_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = sorted_five(spark, d).select("text_id", "ref_id", F.col("sort").alias("acoustic"), (F.col("hits") >= 3).alias("feasible"), (1.0 / F.col("rank")).alias("prior"), (F.col("hits") / F.col("n")).alias("text"), (F.col("n") <= 18).alias("weak"))
    return recall.fusion(rows).select("text_id", "ref_id", F.round("fusion", 6).alias("fusion"))


@query(f"""{SORTED}, w AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY abs(m_all - n_all), sort, ref_id) AS near, row_number() OVER (PARTITION BY text_id ORDER BY sort, ref_id) AS c FROM s)
SELECT text_id, ref_id, CAST(near AS INTEGER) AS near, c = 1 AS champion FROM w WHERE near <= 2 OR c = 1""")
def shortlist_words(spark: SparkSession, d: str) -> DataFrame:
    m = recall.sizes(passages(spark, d), "ref_id").select("ref_id", F.col("all_words").alias("ref_words"))
    return recall.shortlist(sorted_five(spark, d).withColumn("text_words", F.col("n_all")).join(m, "ref_id"), 2).select("text_id", "ref_id", "near", "champion")


@query(f"""{SORTED}, c AS (SELECT text_id, ref_id, sort, round(CAST(hits AS DOUBLE) / n, 9) AS precision, round(CAST(hits AS DOUBLE) / m, 9) AS coverage, hits AS agreeing, 1 - sort AS text_score FROM s),
k AS (SELECT *, CASE WHEN precision >= 0.6 AND agreeing >= 2 THEN 0 WHEN coverage >= 0.4 AND precision >= 0.3 AND text_score >= 0.35 AND agreeing >= 2 THEN 1 ELSE 2 END AS kind FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY kind, CASE kind WHEN 0 THEN -round(precision / 0.05) WHEN 1 THEN -coverage ELSE 0.0 END, sort, ref_id) AS pos,
  (SELECT min(x.sort) FROM c x WHERE x.text_id = k.text_id AND x.ref_id <> k.ref_id) AS other FROM k),
f AS (SELECT *, CASE WHEN kind < 2 THEN greatest(0.0, least(1.0, 0.7 * precision + 0.3 * CASE WHEN other IS NULL OR abs(sort) * 0.15 <= 1e-9 THEN 1.0 ELSE greatest(0.0, least(1.0, (other - sort) / (abs(sort) * 0.15))) END)) END AS confidence FROM o WHERE pos = 1)
SELECT text_id, CASE WHEN kind < 2 THEN ref_id END AS ref_id, CASE WHEN kind = 2 THEN 'unmatched' WHEN kind = 0 AND coverage >= 0.5 AND confidence >= 0.35 THEN CASE WHEN coverage >= 1 THEN 'confirmed' ELSE 'partial' END ELSE 'candidate' END AS status,
CASE WHEN kind = 2 THEN 'unknown' WHEN coverage >= 1 THEN 'completeVerses' ELSE 'partialVerse' END AS scope, round(confidence, 6) AS confidence FROM f""")
def status_scope_case(spark: SparkSession, d: str) -> DataFrame:
    c = sorted_five(spark, d)
    rows = c.select("text_id", "ref_id", "sort", F.round(F.col("hits") / F.col("n"), 9).alias("precision"), F.round(F.col("hits") / F.col("m"), 9).alias("coverage"), (1 - F.col("sort")).alias("text_score"), F.col("hits").alias("agreeing"))
    return recall.arbitrated(rows).select("text_id", "ref_id", "status", "scope", F.round("confidence", 6).alias("confidence"))


@query(f"""{SORTED}, p AS (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS penalty), x AS (SELECT penalty, text_id, ref_id, row_number() OVER (PARTITION BY penalty, text_id ORDER BY round(sort + CAST(penalty AS DOUBLE) * (ref_id % 4), 9), ref_id) AS k FROM s, p)
SELECT CAST(penalty AS DOUBLE) AS penalty, text_id, ref_id FROM x WHERE k = 1""")
def penalty_sweep(spark: SparkSession, d: str) -> DataFrame:
    c = sorted_five(spark, d).select("text_id", "ref_id", F.col("sort").alias("score"), (F.col("ref_id") % 4 + 1).alias("span"))
    return recall.penalty_sweep(c, [0.0, 0.05, 0.1, 0.2])


@query(f"""{SORTED}, b AS (SELECT *, min(sort) OVER (PARTITION BY text_id) AS correct, ref_id % 4 + 1 AS span FROM s)
SELECT text_id, round(coalesce(min((sort - correct) / (span - 1)) FILTER (span > 1), CAST('inf' AS DOUBLE)), 8) AS allowed FROM b GROUP BY 1""")
def penalty_allowed(spark: SparkSession, d: str) -> DataFrame:
    c = sorted_five(spark, d).select("text_id", F.col("sort").alias("score"), F.min("sort").over(Window.partitionBy("text_id")).alias("correct"), (F.col("ref_id") % 4 + 1).alias("span"))
    return recall.allowed_penalty(c).select("text_id", F.round("allowed", 8).alias("allowed"))


@query(f"""{SORTED}, p AS (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS penalty), x AS (SELECT CAST(penalty AS DOUBLE) AS setting, s.*, row_number() OVER (PARTITION BY penalty, text_id ORDER BY round(sort + CAST(penalty AS DOUBLE) * (ref_id % 4), 9), ref_id) AS k FROM s, p),
w AS (SELECT setting, text_id, n, m, hits, CASE WHEN hits >= 3 THEN ref_id % 50 END AS first, ref_id % 50 + ref_id % 4 AS last FROM x WHERE k = 1),
o AS (SELECT *, lag(first) OVER (PARTITION BY setting ORDER BY text_id) AS before, last - first + 1 AS span FROM w WHERE first IS NOT NULL),
told AS (SELECT setting, count(*) AS k, avg(CAST(hits AS DOUBLE) / m) AS coverage, avg(CASE WHEN m > n * 1.6 THEN 1.0 ELSE 0.0 END) AS inflated, avg(CASE WHEN first < before THEN 1.0 WHEN before IS NOT NULL THEN 0.0 END) AS back, avg(span) AS span FROM o GROUP BY 1),
seen AS (SELECT setting, string_agg(concat(span, ':', k), ',' ORDER BY span) AS spans FROM (SELECT setting, span, count(*) AS k FROM o GROUP BY ALL) y GROUP BY 1),
e AS (SELECT setting, count(*) AS windows FROM w GROUP BY 1)
SELECT setting, windows, round(coalesce(k, 0) / CAST(windows AS DOUBLE), 6) AS match_rate, round(coalesce(coverage, 0), 6) AS mean_coverage, round(coalesce(inflated, 0), 6) AS inflation_rate, round(coalesce(back, 0), 6) AS regress_rate, round(coalesce(span, 0), 6) AS mean_span, round(coalesce(span, 0), 6) AS mean_verses, coalesce(spans, '') AS spans
FROM e LEFT JOIN told USING (setting) LEFT JOIN seen USING (setting)""")
def tuning_rates(spark: SparkSession, d: str) -> DataFrame:
    """A row for each span penalty: how often its winners match, inflate and regress, their coverage and spans."""
    from spanloom.operators import choices

    five = kept(sorted_five(spark, d))  # read twice
    swept = recall.penalty_sweep(five.select("text_id", "ref_id", F.col("sort").alias("score"), (F.col("ref_id") % 4 + 1).alias("span")), [0.0, 0.05, 0.1, 0.2])
    won = swept.join(five, ["text_id", "ref_id"])
    first = F.when(F.col("hits") >= 3, F.col("ref_id") % 50)
    rows = won.select(F.col("penalty").alias("setting"), F.col("text_id").alias("n"), first.alias("first"), (F.col("ref_id") % 50 + F.col("ref_id") % 4).alias("last"), (F.col("ref_id") % 4 + 1).alias("verses"), (F.col("hits") / F.col("m")).alias("coverage"), F.col("m").alias("reference_words"), F.col("n").alias("words"))
    told = choices.tuning(rows)
    return told.select("setting", "windows", *(F.round(c, 6).alias(c) for c in ("match_rate", "mean_coverage", "inflation_rate", "regress_rate", "mean_span", "mean_verses")), "spans")


@query(f"""{SORTED}, g AS (SELECT *, lag(ref_id) OVER (PARTITION BY text_id ORDER BY rank) AS before FROM s)
SELECT count(*) AS rows, count(DISTINCT text_id) AS texts, round(avg(CASE WHEN hits * 2 >= m THEN 1.0 ELSE 0.0 END), 6) AS matched, round(avg(CAST(hits AS DOUBLE) / m), 6) AS mean_coverage, count(*) FILTER (ref_id < before) AS regressions, round(avg(CASE WHEN m > n THEN 1.0 ELSE 0.0 END), 6) AS inflated,
round(avg(ref_id % 4 + 1), 6) AS mean_span, (SELECT string_agg(concat(span, ':', k), ',' ORDER BY span) FROM (SELECT ref_id % 4 + 1 AS span, count(*) AS k FROM g GROUP BY 1)) AS spans FROM g""")
def tuning_report(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("ref_id").over(Window.partitionBy("text_id").orderBy("rank"))
    g = kept(sorted_five(spark, d).withColumn("before", before))  # read twice
    matched = F.avg((F.col("hits") * 2 >= F.col("m")).cast("double"))
    span = F.col("ref_id") % 4 + 1
    spans_seen = g.groupBy(span.alias("span")).agg(F.count("*").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "k"))), lambda x: F.concat_ws(":", x["span"].cast("string"), x["k"].cast("string"))), ",").alias("spans"))
    told = g.agg(F.count("*").alias("rows"), F.count_distinct("text_id").alias("texts"), F.round(matched, 6).alias("matched"), F.round(F.avg(F.col("hits") / F.col("m")), 6).alias("mean_coverage"), F.count_if(F.col("ref_id") < F.col("before")).alias("regressions"), F.round(F.avg((F.col("m") > F.col("n")).cast("double")), 6).alias("inflated"), F.round(F.avg(span), 6).alias("mean_span"))
    return told.crossJoin(spans_seen)  # a row each


@query("""SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, coalesce(c.c_name, '') AS name, CAST(coalesce(l.n, 0) AS INTEGER) AS n, coalesce(l.items, '') AS items
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(concat(l_linenumber, ':', l_partkey, ':', l_suppkey), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""")
def hydrate_records(spark: SparkSession, d: str) -> DataFrame:
    records = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey")
    h = store.hydrated(records, "id", items=items).join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    listed = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return h.select(F.col("id").alias("o_orderkey"), "o_custkey", "o_totalprice", F.coalesce("c_name", F.lit("")).alias("name"), F.size("items").alias("n"), listed.alias("items"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def page_records(spark: SparkSession, d: str) -> DataFrame:
    kept = read(spark, d, "orders").where("o_orderstatus = 'F'")
    return store.page(kept, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50, 100).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""WITH e AS (SELECT user_id, event_type, event_id, value FROM events),
l AS (SELECT user_id, event_type, event_id, value FROM e WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
o AS (SELECT user_id, event_type, event_id, value FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM l UNION ALL SELECT * FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM l)""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e, keys = read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"]
    return store.upsert(store.latest(e.where("event_id % 2 = 0"), keys, "event_id"), store.latest(e.where("event_id % 2 = 1"), keys, "event_id"), keys)


@query("""WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM k)),
a AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS display_sequence FROM k)
SELECT o_custkey, CAST(display_sequence AS BIGINT) AS display_sequence FROM a UNION ALL SELECT o_custkey, CAST((SELECT count(*) FROM k) + row_number() OVER (ORDER BY o_custkey) AS BIGINT) FROM n""")
def save_sequence(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("at"))
    empty = o.where("false").withColumn("display_sequence", F.lit(0).cast("long"))
    first = store.save(empty, o.where("at % 2 = 0"), ["o_custkey"])
    return store.save(first, o, ["o_custkey"]).select("o_custkey", "display_sequence")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')")
def late_write_guard(spark: SparkSession, d: str) -> DataFrame:
    late = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return store.guarded(late, read(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_orderkey"]).withColumnRenamed("o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 7 = 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "orders").where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.without(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), gone, ["l_orderkey"])


STATES = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'failed' END"


@query(f"SELECT event_id, CASE WHEN {STATES} = 'running' THEN 'pending' ELSE {STATES} END AS state FROM events")
def job_recovery(spark: SparkSession, d: str) -> DataFrame:
    return store.recovered(read(spark, d, "events").select("event_id", F.expr(STATES).alias("state")))


@query(f"SELECT user_id, event_id, {STATES} AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {STATES} = 'done' DESC, event_id DESC) = 1")
def pick_translation(spark: SparkSession, d: str) -> DataFrame:
    return store.picked(read(spark, d, "events").select("user_id", "event_id", F.expr(STATES).alias("state")), ["user_id"], "event_id")


@query("""WITH t AS (SELECT c.conv_id, c.turn, CASE WHEN (c.conv_id + c.turn) % 5 <> 0 THEN c.text END AS text FROM conversations c), a AS (SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, bool_and(text IS NOT NULL) AS ok, count(*) AS n FROM t GROUP BY 1)
SELECT conv_id, CASE WHEN ok THEN digest END AS digest, CASE WHEN ok THEN 'curatedEdition' ELSE 'machineCanonical' END AS source, CASE WHEN n % 2 = 0 THEN 'fullVerses' WHEN ok THEN 'fullVerseContext' ELSE 'confirmedRange' END AS scope FROM a""")
def curated_all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    needs = c.select("conv_id", F.col("turn").alias("ordinal"), "turn").withColumn("key", F.col("conv_id"))
    texts = c.where("(conv_id + turn) % 5 <> 0").select(F.col("conv_id").alias("key"), "turn", "text")
    all_ = store.curated(needs, texts, "conv_id", ["key", "turn"])
    n = c.groupBy("conv_id").agg(F.count("*").alias("n")).join(all_, "conv_id", "left")
    source = store.source_of(F.col("n"), F.col("text"), F.col("n") % 2 == 0)
    return n.select("conv_id", F.md5("text").alias("digest"), source["source"].alias("source"), source["scope"].alias("scope"))


@query("SELECT doc_id, 'documents' AS origin FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: read(spark, d, t).select("doc_id", F.lit(t).alias("origin"))
    return one("documents").unionByName(one("labels"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH n AS (SELECT page_id, 'Corpus_' || lpad(CAST(page_id % 200 AS VARCHAR), 3, '0') || '_001_' || lpad(CAST(page_id % 7 AS VARCHAR), 3, '0') || CASE WHEN page_id % 3 = 0 THEN '.mp3' ELSE '.WAV' END AS name FROM pages)
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 200 AS INTEGER) END AS chapter, CASE WHEN page_id % 3 <> 0 THEN 1 END AS first, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 7 AS INTEGER) END AS last FROM n""")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    p = F.col("page_id")
    name = F.concat(F.lit("Corpus_"), three(p % 200), F.lit("_001_"), three(p % 7), F.when(p % 3 == 0, ".mp3").otherwise(".WAV"))
    return read(spark, d, "pages").select("page_id", T.file_range(name).alias("r")).select("page_id", "r.chapter", "r.first", "r.last")


@query("""SELECT conv_id, turn, coalesce(turn - lag(turn) OVER w BETWEEN 0 AND 3, true) AS loose, coalesce(turn - lag(turn) OVER w BETWEEN 1 AND 3, false) AS strict FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def continuation_flag(spark: SparkSession, d: str) -> DataFrame:
    ref = T.ref_key(F.col("conv_id"), F.col("turn"))
    before = F.lag("ref").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = read(spark, d, "conversations").select("conv_id", "turn", ref.alias("ref")).withColumn("before", before)
    return c.select("conv_id", "turn", T.is_continuation(F.col("before"), F.col("ref")).alias("loose"), T.is_next(F.col("before"), F.col("ref")).alias("strict"))


@query("""SELECT bool_and(quality = 1 OR toxic = 0) AS gate, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) AS total FROM labels""")
def gate_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").agg(F.bool_and((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("gate"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("total"))


@query("SELECT CAST(conv_id AS INTEGER) AS chapter, count(*) AS verses FROM conversations GROUP BY 1")
def verses_per_chapter(spark: SparkSession, d: str) -> DataFrame:
    return verses(spark, d).groupBy("chapter").agg(F.count("*").alias("verses"))


@query("""SELECT doc_id, sha256(text) AS digest FROM documents""")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {VERSES}, p AS (SELECT chapter, verse, text, lead(text) OVER (PARTITION BY chapter ORDER BY verse) AS b FROM v), w AS (SELECT chapter, verse, list_distinct({split('text')}) AS x, list_distinct({split('b')}) AS y FROM p WHERE b IS NOT NULL)
SELECT chapter, verse, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, CAST(len(x) AS INTEGER) AS n FROM w""")
def shared_words(spark: SparkSession, d: str) -> DataFrame:
    after = F.lead("text").over(Window.partitionBy("chapter").orderBy("verse"))
    w = lambda c: F.array_distinct(T.words(T.normalize(F.col(c))))
    p = verses(spark, d).withColumn("b", after).where("b is not null")
    return p.select("chapter", "verse", F.size(F.array_intersect(w("text"), w("b"))).alias("shared"), F.size(w("text")).alias("n"))
