"""Queries of records, jobs and previews, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import choices as C
from spanloom.operators import store
from spanloom.plans.relations import SORTED, VERSES, sorted_five, split
from spanloom.sources.tables import read, verses

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def record_by_id(spark: SparkSession, d: str) -> DataFrame:
    return store.by_id(read(spark, d, "orders"), 7, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


STATES = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'failed' END"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", F.expr(STATES).alias("state"), "ts", (F.col("event_id") % 3).cast("int").alias("attempts"))


@query(f"SELECT event_id, {STATES} AS state FROM events WHERE {STATES} IN ('pending', 'running') ORDER BY ts, event_id LIMIT 20")
def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return store.pending(jobs(spark, d), 20, "state", "ts", "event_id").select("event_id", "state")


@query(f"SELECT event_id, CASE WHEN {STATES} = 'failed' AND user_id % 2 = 0 THEN 'pending' ELSE {STATES} END AS state, CAST(event_id % 3 + CASE WHEN {STATES} = 'failed' AND user_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM events")
def retry_jobs(spark: SparkSession, d: str) -> DataFrame:
    return store.retried(jobs(spark, d), F.col("state") == "failed", F.col("user_id") % 2 == 0).select("event_id", "state", "attempts")


@query("SELECT (SELECT count(*) FROM orders WHERE false) AS records, (SELECT count(*) FROM lineitem WHERE false) AS matches, (SELECT count(*) FROM events) AS cached, CAST(1 AS BIGINT) AS next_number")
def delete_all(spark: SparkSession, d: str) -> DataFrame:
    records, matches = store.cleared(read(spark, d, "orders"), read(spark, d, "lineitem"))
    n = lambda t, name: t.agg(F.count("*").alias(name))
    number = records.agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).cast("long").alias("next_number"))
    return n(records, "records").crossJoin(n(matches, "matches")).crossJoin(n(read(spark, d, "events"), "cached")).crossJoin(number)  # a row each


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['chinese'] WHEN 1 THEN ['english', 'french'] ELSE CAST([] AS VARCHAR[]) END AS targets FROM orders)
SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey % 2 = 0 AND NOT list_contains(targets, 'french') THEN list_append(targets, 'french') ELSE targets END, ',') AS targets FROM t""")
def add_language(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    targets = F.when(k % 3 == 0, F.array(F.lit("chinese"))).when(k % 3 == 1, F.array(F.lit("english"), F.lit("french"))).otherwise(F.array().cast("array<string>"))
    records = read(spark, d, "orders").select("o_orderkey", targets.alias("targets"))
    return store.with_language(records, k % 2 == 0, "french").select("o_orderkey", F.array_join("targets", ",").alias("targets"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber AS ordinal, l_partkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber <= 2), s AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)
SELECT l_orderkey, l_linenumber AS ordinal, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM n WHERE l_orderkey IN (SELECT o_orderkey FROM s)""")
def replace_matches(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), "l_partkey")
    again = read(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    drafts = again.join(items.where("ordinal <= 2"), "l_orderkey", "left").select("l_orderkey", "ordinal", "l_partkey")
    return store.saved_matches(items, drafts, "l_orderkey")


@query("""WITH c AS (SELECT user_id, max(event_id) // 100 AS version FROM events GROUP BY 1) SELECT e.user_id, e.event_id FROM events e JOIN c ON c.user_id = e.user_id AND c.version = e.event_id // 100""")
def late_results(spark: SparkSession, d: str) -> DataFrame:
    results = read(spark, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 100).alias("version"))
    current = results.groupBy("user_id").agg(F.max("version").alias("version"))
    return store.still_current(results, current, ["user_id"], "version").select("user_id", "event_id")


REFS = "CASE WHEN event_type = 'view' THEN '' ELSE event_type END"
PREVIEWS = f"""p AS (SELECT user_id, event_id, {REFS} AS refs FROM events), n AS (SELECT *, CASE WHEN refs <> '' AND refs = lag(refs) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS generation FROM n)"""


def previews(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "events").select("user_id", "event_id", F.expr(REFS).alias("refs"))
    return C.preview_stability(p, "user_id", "event_id", "refs")


@query(f"WITH {PREVIEWS} SELECT user_id, event_id, refs, CAST(generation AS BIGINT) AS generation, CAST(CASE WHEN refs = '' THEN 0 ELSE row_number() OVER (PARTITION BY user_id, generation ORDER BY event_id) END AS INTEGER) AS rounds FROM g")
def preview_stability(spark: SparkSession, d: str) -> DataFrame:
    return previews(spark, d)


@query(f"WITH {PREVIEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, generation ORDER BY event_id) AS k, lead(generation) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM g) SELECT user_id, event_id, refs FROM r WHERE refs <> '' AND k >= 2 AND nx <> generation")
def dropped_translations(spark: SparkSession, d: str) -> DataFrame:
    return C.dropped_previews(previews(spark, d).withColumn("shown", F.col("rounds") >= 2), "user_id", "event_id", "shown").select("user_id", "event_id", "refs")


@query("""WITH q AS (SELECT user_id, event_id, abs(value) < 60 AS quiet FROM events), r AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM q)
SELECT user_id, event_id, CAST(sum(CASE WHEN quiet THEN 0.5 ELSE 0.0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS DOUBLE) AS still FROM r""")
def silence_so_far(spark: SparkSession, d: str) -> DataFrame:
    levels = read(spark, d, "events").select("user_id", "event_id", (F.abs("value") < 60).alias("quiet"), F.lit(0.5).alias("seconds"))
    return C.silence_so_far(levels, "user_id", "event_id", "quiet", "seconds").select("user_id", "event_id", "still")


@query("""WITH f AS (SELECT user_id, event_type, abs(value) AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
SELECT user_id, count(*) AS n, floor(round(avg(round(v, 2)), 8) * 100 + 0.5) / 100 AS confidence FROM f GROUP BY 1""")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.round(F.abs("value"), 2).alias("score"))
    firsts = C.unseen(e, "user_id", "event_type", "event_id")
    return firsts.groupBy("user_id").agg(F.count("*").alias("n"), (F.floor(F.round(F.avg("score"), 8) * 100 + 0.5) / 100).alias("confidence"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def duplicate_guard(spark: SparkSession, d: str) -> DataFrame:
    return C.unseen(read(spark, d, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "event_id")


@query(f"{SORTED} SELECT text_id, ref_id, sort FROM s QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY sort, ref_id) = 1")
def weakest_candidate(spark: SparkSession, d: str) -> DataFrame:
    return C.weakest(sorted_five(spark, d), "text_id", "sort", "ref_id").select("text_id", "ref_id", "sort")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def best_variant(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").withColumn("variant", F.struct("l_linenumber", "l_partkey"))
    return C.best_variant(items, "l_orderkey", "variant", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH b AS (SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) SELECT o_custkey, o_orderkey, best FROM orders JOIN b ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY best DESC, o_orderkey) = 1""")
def best_of_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import joint

    best = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("score"))
    found = read(spark, d, "orders").join(best, "o_orderkey").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("text_id"), "score")
    return joint.best_hypothesis(found).select(F.col("group").alias("o_custkey"), F.col("text_id").alias("o_orderkey"), F.col("score").alias("best"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def recent_list(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 20").select("user_id", "event_id")


@query("""WITH v AS (SELECT vec_id, list_filter(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN (i - 1) % (len(embedding) // 16) = 0 THEN CAST(embedding[i] AS DOUBLE) END), lambda x: x IS NOT NULL) AS x FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda y: y * y)) / len(x)), 6) AS rms, round(vec_id / 16000.0, 6) AS seconds FROM v""")
def strided_level(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.round(T.strided_rms(F.col("embedding"), 16), 6).alias("rms"), F.round(T.seconds(F.col("vec_id")), 6).alias("seconds"))


@query("SELECT c_custkey, concat_ws(' · ', c_name, nullif(trim(n_name), '')) AS label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", T.source_label(F.col("c_name"), F.col("n_name"), F.lit(" ")).alias("label"))


@query("""WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'zh' WHEN 1 THEN 'english' WHEN 2 THEN 'klingon' WHEN 3 THEN ' ' ELSE 'en' END AS v FROM events),
n AS (SELECT event_id, CASE nullif(trim(v), '') WHEN 'zh' THEN 'chinese' WHEN 'en' THEN 'english' ELSE nullif(trim(v), '') END AS language FROM l) SELECT event_id, language, language IN ('chinese', 'english') AS known FROM n""")
def language_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, "zh").when(k == 1, "english").when(k == 2, "klingon").when(k == 3, " ").otherwise("en")
    return read(spark, d, "events").select("event_id", T.language_id(v, ["chinese", "english"]).alias("l")).select("event_id", F.col("l.id").alias("language"), F.col("l.known").alias("known"))


@query("""WITH m AS (SELECT l_orderkey, list({'chapter': l_linenumber % 2, 'verse': l_partkey} ORDER BY l_linenumber, l_partkey) AS m FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, coalesce(m, []) AS m, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'partial' ELSE 'candidate' END AS status FROM orders LEFT JOIN m ON l_orderkey = o_orderkey),
s AS (SELECT *, len(m) AS n, list_min(list_transform(m, lambda x: x.verse)) AS a, list_max(list_transform(m, lambda x: x.verse)) AS b, list_min(list_transform(m, lambda x: x.chapter)) = list_max(list_transform(m, lambda x: x.chapter)) AS same FROM o)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'no match' ELSE concat(CASE WHEN n = 1 OR same AND a = b THEN concat(m[1].chapter, ':', CASE WHEN n = 1 THEN m[1].verse ELSE a END) WHEN same THEN concat(m[1].chapter, ':', a, '-', b) ELSE concat(m[1].chapter, ':', m[1].verse, ' +', n - 1) END,
CASE WHEN status = 'confirmed' THEN '' ELSE concat(' (', status, ')') END) END AS label FROM s""")
def match_labels(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    matches = F.coalesce(F.transform("m", lambda x: F.struct((x["l_linenumber"] % 2).alias("chapter"), x["l_partkey"].alias("verse"))), F.array())
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "partial").otherwise("candidate")
    o = read(spark, d, "orders").join(m, "o_orderkey", "left")
    typed = o.withColumn("matches", F.coalesce(F.transform("m", lambda x: F.struct((x["l_linenumber"] % 2).alias("chapter"), x["l_partkey"].alias("verse"))), F.transform(F.slice(F.array(F.struct(F.lit(0).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"))), 1, 0), lambda x: F.struct((x["l_linenumber"] % 2).alias("chapter"), x["l_partkey"].alias("verse")))))
    return typed.select("o_orderkey", T.match_label(F.col("matches"), status).alias("label"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 24 THEN concat(rtrim(substr(text, 1, 24), ' '), '…') ELSE text END AS preview FROM conversations")
def record_preview(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.shortened(F.col("text"), 24).alias("preview"))


@query("""SELECT event_id, concat('{"ref":"', user_id, ':', event_id % 9, '","kind":"', event_type, '"', CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"rank":', event_id % 4) END, '}') AS evidence FROM events""")
def evidence_json(spark: SparkSession, d: str) -> DataFrame:
    """Absent measures have no entry."""
    k = F.col("event_id")
    told = F.struct(F.concat_ws(":", F.col("user_id").cast("string"), (k % 9).cast("string")).alias("ref"), F.col("event_type").alias("kind"), F.when(k % 4 != 0, k % 4).alias("rank"))
    return read(spark, d, "events").select("event_id", F.to_json(told).alias("evidence"))


@query(f"SELECT doc_id, CAST(len({split('text')}) AS INTEGER) AS n_words FROM documents WHERE len({split('text')}) > 0 AND trim(text) <> '' AND doc_id % 7 <> 0 OR doc_id % 7 = 0 AND len({split('text')}) > 0")
def spoken_only(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts without a word are dropped as noise."""
    n = F.size(T.words(T.normalize(F.col("text"))))
    return read(spark, d, "documents").select("doc_id", n.alias("n_words"), "text").where((F.col("n_words") > 0) & (F.trim("text") != "")).select("doc_id", "n_words")


@query(f"""WITH {VERSES} SELECT chapter, verse, text FROM v WHERE verse = 1""")
def chapter_verses(spark: SparkSession, d: str) -> DataFrame:
    asked = verses(spark, d).select("chapter").distinct().withColumn("verse", F.lit(1))
    return verses(spark, d).join(asked, ["chapter", "verse"])


@query("SELECT DISTINCT lang, substr(source, 1, 3) AS key FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def available_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("trim(text) <> ''").select("lang", F.substring("source", 1, 3).alias("key")).distinct()


@query(f"""WITH {VERSES}, w AS (SELECT chapter, verse, {split('text')} AS w, list_filter(range(0, 60), lambda i: i % (chapter % 5 + 2) = 0) AS g FROM v)
SELECT chapter, verse, CAST(len(CASE WHEN len(g) < len(w) THEN w[1:len(g)] ELSE w END) AS INTEGER) AS words, CAST(len(CASE WHEN len(g) > len(w) THEN g[len(g) - len(w) + 1:] ELSE g END) AS INTEGER) AS groups, CAST(CASE WHEN len(w) > 0 THEN (CASE WHEN len(g) > len(w) THEN g[len(g) - len(w) + 1] ELSE g[1] END) END AS INTEGER) AS first FROM w""")
def aligned_words(spark: SparkSession, d: str) -> DataFrame:
    w = T.words(T.normalize(F.col("text")))
    g = F.filter(F.sequence(F.lit(0), F.lit(59)), lambda i: i % (F.col("chapter") % 5 + 2) == 0)
    a = verses(spark, d).select("chapter", "verse", w.alias("w"), g.alias("g")).withColumn("a", C.head_cut(F.col("w"), F.col("g")))
    return a.select("chapter", "verse", F.size("a.words").alias("words"), F.size("a.groups").alias("groups"), F.get("a.groups", F.lit(0)).alias("first"))
