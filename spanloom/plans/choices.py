"""Queries of the small relational choices, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import choices as C
from spanloom.plans.relations import FRAMES, SORTED, VERSES, sorted_five, split
from spanloom.sources.tables import frames, read, verses

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def keyed_first(spark: SparkSession, d: str) -> DataFrame:
    return C.first_of(read(spark, d, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "c_name")


@query(f"WITH {VERSES}, s AS (SELECT chapter, min(verse) AS first, max(verse) AS last FROM v GROUP BY 1) SELECT chapter, first, last, CAST(unnest(range(first, last + 1)) AS INTEGER) AS verse FROM s")
def span_expansion(spark: SparkSession, d: str) -> DataFrame:
    return C.expanded(verses(spark, d).groupBy("chapter").agg(F.min("verse").alias("first"), F.max("verse").alias("last")))


@query("""WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority AS ref FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT DISTINCT o_custkey, o_orderpriority AS ref FROM orders WHERE o_orderkey % 3 <> 0),
k AS (SELECT o_custkey FROM e UNION SELECT o_custkey FROM s), h AS (SELECT e.o_custkey, count(*) AS expected, count(s.ref) AS found FROM e LEFT JOIN s ON e.o_custkey = s.o_custkey AND e.ref = s.ref GROUP BY 1)
SELECT o_custkey, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, found = expected AS hit FROM k LEFT JOIN h USING (o_custkey)""")
def expected_refs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("ref"), "o_orderkey")
    return C.contained(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0"), "o_custkey")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) - 1 AS INTEGER) AS place FROM f""")
def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    return C.first_seen(read(spark, d, "events"), "user_id", "event_type", "event_id")


@query(f"{SORTED}, g AS (SELECT text_id, ref_id % 4 AS chapter, min(rank) AS best FROM s GROUP BY 1, 2) SELECT text_id, chapter, best FROM g QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY best, chapter) <= 3")
def top_chapters(spark: SparkSession, d: str) -> DataFrame:
    return C.leading_groups(sorted_five(spark, d).withColumn("chapter", F.col("ref_id") % 4), "text_id", "chapter", "rank", 3)


@query(f"""WITH {VERSES}, w AS (SELECT chapter, verse, {split('text')} AS words FROM v),
x AS (SELECT chapter, verse, 0 AS variant, len(words) AS n FROM w UNION ALL SELECT chapter, verse, 1, len(words) - 2 FROM w WHERE len(words) > 2 AND words[1:2] = ['The', 'and'])
SELECT chapter, verse, CAST(variant AS INTEGER) AS variant, CAST(n AS INTEGER) AS n FROM x""")
def reference_variants(spark: SparkSession, d: str) -> DataFrame:
    w = verses(spark, d).select("chapter", "verse", T.words(T.normalize(F.col("text"))).alias("words"))
    return C.variants(w, ["The", "and"]).select("chapter", "verse", "variant", F.size("words").alias("n"))


@query(f"{SORTED} SELECT text_id, ref_id, round(coalesce(lead(sort) OVER (PARTITION BY text_id ORDER BY sort, hits DESC, ref_id) - sort, 0), 6) AS acoustic_margin FROM s")
def acoustic_margin(spark: SparkSession, d: str) -> DataFrame:
    m = C.acoustic_margins(sorted_five(spark, d).withColumnsRenamed({"sort": "acoustic", "hits": "prior"}))
    return m.select("text_id", "ref_id", F.round("acoustic_margin", 6).alias("acoustic_margin"))


LENGTHS = "l AS (SELECT event_id, CAST(abs(round(value)) AS DOUBLE) AS seconds FROM events)"


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.abs(F.round("value")).cast("double").alias("seconds"))


@query(f"""WITH {LENGTHS}, w AS (SELECT event_id, seconds, unnest(CASE WHEN seconds > 30 THEN [0, 1, 2] ELSE [0] END) AS n FROM l),
s AS (SELECT *, round(CASE WHEN seconds > 30 THEN (seconds - 30) * n / 2.0 ELSE 0 END, 6) AS start FROM w) SELECT event_id, CAST(n AS INTEGER) AS n, CAST(start AS DOUBLE) AS start, CAST(round(least(start + 30, seconds), 6) AS DOUBLE) AS "end" FROM s""")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_windows(lengths(spark, d), 30.0).select("event_id", "n", "start", "end")


@query(f"""WITH {LENGTHS}, w AS (SELECT event_id, seconds, unnest(range(0, CAST(floor((seconds - 25) / 8) AS BIGINT) + 1)) AS n FROM l WHERE seconds >= 25) SELECT event_id, n, CAST(n * 8 AS DOUBLE) AS start, CAST(least(n * 8 + 25, seconds) AS DOUBLE) AS "end" FROM w""")
def full_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.sliding_windows(lengths(spark, d), 25.0, 8.0).select("event_id", "n", "start", "end")


@query(f"""WITH {LENGTHS}, w AS (SELECT event_id, seconds, unnest(range(0, CAST(floor((seconds - 0.1) / 7.5) AS BIGINT) + 1)) AS n FROM l WHERE seconds >= 0.1) SELECT event_id, n, CAST(n * 7.5 AS DOUBLE) AS start, CAST(least(n * 7.5 + 15, seconds) AS DOUBLE) AS "end" FROM w""")
def tailed_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.sliding_windows(lengths(spark, d), 15.0, 7.5, 0.1).select("event_id", "n", "start", "end")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, round(abs(value), 6) AS rms FROM events),
t AS (SELECT user_id, greatest(1e-5, list_sort(list(rms))[count(*) // 2 + 1] * 0.4) AS t, max(rms) AS m FROM e GROUP BY 1),
q AS (SELECT e.user_id, n, n - row_number() OVER (PARTITION BY e.user_id ORDER BY n) AS g FROM e JOIN t ON e.user_id = t.user_id WHERE rms < t AND m >= 1e-5)
SELECT user_id, min(n) AS first, max(n) AS last FROM q GROUP BY user_id, g HAVING (max(n) - min(n) + 1) * 0.2 >= 0.4 - 1e-9""")
def quiet_pauses(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = read(spark, d, "events").select("user_id", n.cast("long").alias("n"), F.round(F.abs("value"), 6).alias("rms"))
    return C.pauses(e, "user_id", 0.2, 0.4, 0.4).select("user_id", "first", "last")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS matched, count(*) FILTER (o_orderstatus <> 'P' AND o_custkey % 5 = o_orderkey % 5) AS in_chapter FROM orders")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "unmatched").otherwise("confirmed").alias("status"), (F.col("o_custkey") % 5).alias("chapter"), (F.col("o_orderkey") % 5).alias("expected"))
    return C.summary(o)


@query(f"WITH {FRAMES}, g AS (SELECT vec_id // 20 AS utt_id, CAST(vec_id % 20 AS INTEGER) AS t, CAST(list_position(list_transform(embedding, lambda x: round(x, 1)), list_max(list_transform(embedding, lambda x: round(x, 1)))) - 1 AS INTEGER) AS token FROM embeddings) SELECT round(avg(CASE WHEN f.token = g.token THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM f JOIN g USING (utt_id, t)")
def argmax_agreement(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return C.argmax_agreement(f, f.withColumn("scores", F.transform("scores", lambda x: F.round(x, 1))), ["utt_id", "t"])


@query("SELECT o_custkey, o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def benchmark_join(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return read(spark, d, "orders").join(c, "o_custkey", "left").select("o_custkey", "o_orderkey", "c_name")


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY CASE n_name WHEN 'CHINA' THEN 0 WHEN 'UNITED STATES' THEN 1 ELSE 2 END, n_name, n_nationkey) AS INTEGER) AS place FROM nation")
def language_order(spark: SparkSession, d: str) -> DataFrame:
    """A fixed dimension of a few rows, so one ordered list."""
    from pyspark.sql import Window

    first = F.when(F.col("n_name") == "CHINA", 0).when(F.col("n_name") == "UNITED STATES", 1).otherwise(2)
    return read(spark, d, "nation").select("n_nationkey", "n_name", F.row_number().over(Window.orderBy(first, "n_name", "n_nationkey")).alias("place"))
