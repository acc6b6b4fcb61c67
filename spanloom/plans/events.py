"""Queries over the event stream: runs, windows, gates and folds, with SQL where it can say them."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.deal import united
from spanloom.plans.relations import normal, split
from spanloom.sources.tables import read, verses
from spanloom.streaming import folds, live, tracking, transcribe
from spanloom.streaming import segments as S
from spanloom.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS INTEGER) AS length, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) >= 2 AS stable FROM g""")
def stability_runs(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    new = F.coalesce((F.col("event_type") != F.lag("event_type").over(order)).cast("int"), F.lit(1))
    g = events(spark, d).select("user_id", "event_id", "event_type").withColumn("new", new).withColumn("run", F.sum("new").over(order))
    n = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id"))
    return g.select("user_id", "event_id", "event_type", n.alias("length"), (n >= 2).alias("stable"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)")
def run_dedupe(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return events(spark, d).select("user_id", "event_id", "event_type", before.alias("b")).where("not event_type <=> b").drop("b")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS session_start, CAST(max(ts) AS VARCHAR) AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def silence_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = W.sessions(W.timed(events(spark, d)), "6 hours")
    return s.select("user_id", F.col("session_start").cast("string").alias("session_start"), F.col("session_end").cast("string").alias("session_end"), "n")


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    return W.windowed(W.timed(events(spark, d)), "1 day").withColumn("window_start", F.col("window_start").cast("string"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS window_start, event_type, value FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT CAST(window_start AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY 1, 2""")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return W.windowed(W.timed(events(spark, d)), "24 hours", "6 hours").withColumn("window_start", F.col("window_start").cast("string"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, abs(value) / 1000 AS rms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT user_id, n, least(rms, 0.008) AS base FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, least(e.rms, b.base * 1.02) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT b.user_id, e.event_id, round(b.base, 10) AS baseline FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n""")
def baseline_follower(spark: SparkSession, d: str) -> DataFrame:
    """The level follows down at once, to silence for good, and up by 2 % a chunk."""
    e = events(spark, d).select("user_id", "event_id", (F.abs("value") / 1000).alias("rms"))
    return folds.run_batch(e, "user_id", "event_id", S.Follower, S.follow_step, S.FOLLOWED).withColumn("baseline", F.round("baseline", 10))


@query("""WITH v AS (SELECT user_id, list_sort(list(round(abs(value), 6))) AS x FROM events GROUP BY 1)
SELECT user_id, x[len(x) // 2 + 1] AS median, x[CAST(floor((len(x) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90 FROM v""")
def frame_median_p90(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import choices

    v = events(spark, d).select("user_id", F.round(F.abs("value"), 6).alias("x"))
    return choices.ranked_values(v, "user_id", "x", median=choices.upper_median, p90=choices.ninetieth)


@query("""WITH v AS (SELECT user_id, event_id // 2000 AS part, list_sort(list(round(abs(value), 6))) AS x FROM events GROUP BY 1, 2),
o AS (SELECT user_id, part, len(x) AS n, x[len(x) // 2 + 1] AS median, x[CAST(floor((len(x) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90 FROM v),
f AS (SELECT *, min(median) OVER (PARTITION BY user_id ORDER BY part) AS low FROM o)
SELECT user_id, part, n >= 8 AND p90 >= greatest(2.5 * median, 2.0 * low, 0.004) AS speech FROM f""")
def vad_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stretch of frames holds speech: its 90th percentile against its median and the session's lowest median so far."""
    v = events(spark, d).groupBy("user_id", F.floor(F.col("event_id") / 2000).alias("part")).agg(F.collect_list(F.round(F.abs("value"), 6)).alias("x"))
    o = v.select("user_id", "part", F.size("x").alias("n"), T.order_statistics(F.col("x")).alias("o"))
    low = F.min("o.median").over(Window.partitionBy("user_id").orderBy("part"))
    return o.withColumn("low", low).select("user_id", "part", ((F.col("n") >= 8) & (F.col("o.p90") >= F.greatest(2.5 * F.col("o.median"), 2.0 * F.col("low"), F.lit(0.004)))).alias("speech"))


@query("""WITH s AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS n FROM events),
w AS (SELECT user_id, event_id, n, unnest(CASE WHEN n <= 0 THEN [] WHEN n <= 30 THEN [0] ELSE list_concat(list_filter(range(0, n, 22), lambda x: x = 0 OR (x - 22 + 30 < n AND n - x >= 10)),
  list_filter([n - 30], lambda x: len(list_filter(range(22, n, 22), lambda y: y - 22 + 30 < n AND n - y < 10)) > 0 AND x % 22 <> 0)) END) AS start FROM s)
SELECT user_id, event_id, CAST(start AS BIGINT) AS start, CAST(least(start + 30, n) AS BIGINT) AS "end" FROM w""")
def bounded_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 30 that overlap by 8; one that would leave less than 10 reaches back to be full."""
    n, at = F.col("n"), F.col("start")
    s = events(spark, d).select("user_id", "event_id", F.floor("value").cast("long").alias("n")).where("n > 0")
    grid = s.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(22).cast("long")))).where((at == 0) | (at + 8 < n))
    # a window begins only while the one before doesn't reach the end; a short tail starts 30 before the end instead
    moved = F.when((at > 0) & (n - at < 10), F.greatest(F.lit(0).cast("long"), n - 30)).otherwise(at)
    return grid.select("user_id", "event_id", "n", moved.alias("start")).distinct().select("user_id", "event_id", "start", F.least(at + 30, n).alias("end"))


@query("""WITH RECURSIVE l AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
  round(abs(value) / 1000 * CASE WHEN event_id % 7 < 4 THEN 0.01 ELSE 1.0 END, 9) AS rms, round(abs(value) / 1000 * 4, 9) AS peak FROM events),
f AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS now, CAST(0 AS DOUBLE) AS silent, CAST(-1 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS peak,
    CAST(0 AS DOUBLE) AS began, CAST(NULL AS VARCHAR) AS reason, false AS speech, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS boundary, false AS due FROM l
  UNION ALL
  SELECT session, k2, start2, now2, silent3, level2, peak3, start, why, speech2, CASE WHEN due2 THEN now2 ELSE last END, boundary2, due2
  FROM (SELECT *, least(now2 - last, now2 - boundary2, now2 - start2) >= 1.0 - 1e-9 AS due2
  FROM (SELECT *, CASE WHEN why IS NOT NULL THEN now2 ELSE boundary END AS boundary2, CASE WHEN why = 'maxDuration' THEN now2 - least(now2 - start, 1.0) WHEN why IS NOT NULL THEN now2 ELSE start END AS start2, CASE WHEN why IS NULL THEN silent2 ELSE 0 END AS silent3, CASE WHEN why IS NULL THEN peak2 ELSE 0 END AS peak3, peak2 >= greatest(0.008, level2) * 3.0 AS speech2
  FROM (SELECT *, CASE WHEN silent2 >= 1.2 AND now2 - start >= 0.8 THEN 'silence' WHEN now2 - start >= 30.0 THEN 'maxDuration' END AS why
    FROM (SELECT *, CASE WHEN rms < greatest(0.008, level2 * 2.0) THEN silent + 0.5 ELSE 0 END AS silent2
      FROM (SELECT f.*, l.k AS k2, l.rms, least(l.rms, CASE WHEN f.level < 0 THEN 0.008 ELSE f.level * 1.02 END) AS level2, f.now + 0.5 AS now2, greatest(f.peak, l.peak) AS peak2
        FROM f JOIN l ON l.session = f.session AND l.k = f.k + 1) a) b) c) d) g)
SELECT session, round(greatest(start, now - 12.0), 6) AS start, round(now, 6) AS "end" FROM f WHERE due""")
def preview_requests(spark: SparkSession, d: str) -> DataFrame:
    """session, start, end: the stretches that previews are made of while utterances are open."""
    c = S.SegmenterConfig()
    return folds.run_batch(S.levels(events(spark, d)), "session", "n", S.Previews, lambda s, x: S.preview_step(s, x, c), S.PREVIEW)


@query("""WITH RECURSIVE l AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
  round(abs(value) / 1000 * CASE WHEN event_id % 7 < 4 THEN 0.01 ELSE 1.0 END, 9) AS rms, round(abs(value) / 1000 * 4, 9) AS peak FROM events),
f AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS now, CAST(0 AS DOUBLE) AS silent, CAST(-1 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS peak,
    CAST(0 AS DOUBLE) AS began, CAST(NULL AS VARCHAR) AS reason, false AS speech FROM l
  UNION ALL
  SELECT session, k2, CASE WHEN why = 'maxDuration' THEN now2 - least(now2 - start, 1.0) WHEN why IS NOT NULL THEN now2 ELSE start END, now2,
    CASE WHEN why IS NULL THEN silent2 ELSE 0 END, level2, CASE WHEN why IS NULL THEN peak2 ELSE 0 END, start, why, peak2 >= greatest(0.008, level2) * 3.0
  FROM (SELECT *, CASE WHEN silent2 >= 1.2 AND now2 - start >= 0.8 THEN 'silence' WHEN now2 - start >= 30.0 THEN 'maxDuration' END AS why
    FROM (SELECT *, CASE WHEN rms < greatest(0.008, level2 * 2.0) THEN silent + 0.5 ELSE 0 END AS silent2
      FROM (SELECT f.*, l.k AS k2, l.rms, least(l.rms, CASE WHEN f.level < 0 THEN 0.008 ELSE f.level * 1.02 END) AS level2, f.now + 0.5 AS now2, greatest(f.peak, l.peak) AS peak2
        FROM f JOIN l ON l.session = f.session AND l.k = f.k + 1) a) b) c)
SELECT session, round(began, 6) AS start, round(now, 6) AS "end", reason, speech AS has_speech FROM f WHERE reason IS NOT NULL
UNION ALL
SELECT session, round(start, 6), round(now, 6), 'stopped', peak >= greatest(0.008, level) * 3.0
FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC) = 1) z WHERE now - start >= 0.4""")
def segment_utterances(spark: SparkSession, d: str) -> DataFrame:
    c = S.SegmenterConfig()
    return folds.run_batch(S.levels(events(spark, d)), "session", "n", S.Segmenter, lambda s, x: S.segment_step(s, x, c), S.SEGMENT, lambda s: S.segment_flush(s, c))


@query(f"""WITH RECURSIVE l AS (SELECT CAST(conv_id AS INTEGER) AS chapter, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  list_filter(string_split(regexp_replace(coalesce(text, ''), '{T.SPACES}', ' ', 'g'), ' '), lambda w: w <> '') AS new FROM conversations),
n AS (SELECT *, list_transform(new, lambda w: {normal("w")}) AS flat FROM l),
f AS (
  SELECT DISTINCT chapter, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS tail, 0 AS count, CAST([] AS VARCHAR[]) AS added FROM l
  UNION ALL
  SELECT chapter, k2, list_slice(list_concat(tail, flat[same + 1:]), -80, -1), CAST(count + len(new) - same AS INTEGER), new[same + 1:]
  FROM (SELECT f.*, n.k AS k2, n.new, n.flat, coalesce(list_max(list_filter(range(1, least(len(n.new), 80, len(f.tail)) + 1), lambda i: (i >= 2 OR i = len(n.flat)) AND list_slice(f.tail, -i, -1) = n.flat[1:i])), 0) AS same
    FROM f JOIN n ON n.chapter = f.chapter AND n.k = f.k + 1) a)
SELECT chapter, count, md5(array_to_string(added, ' ')) AS digest FROM f WHERE len(added) > 0""")
def stitch_stream(spark: SparkSession, d: str) -> DataFrame:
    v = verses(spark, d).select("chapter", F.col("verse").alias("n"), "text")
    return folds.run_batch(v, "chapter", "n", S.Stitcher, S.stitch_step, S.STITCHED).select("chapter", "count", F.md5("added").alias("digest"))


@query(f"""WITH RECURSIVE w AS (SELECT CAST(conv_id AS INTEGER) AS chapter, turn, row_number() OVER v AS k, turn = max(turn) OVER (PARTITION BY conv_id) AS final, turn * CAST(4 AS DOUBLE) AS begun, {split("text")} AS w FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT chapter, k, final, begun, list_transform(range(1, len(w) + 1), lambda i: struct_pack(w := w[i], a := round(begun + (i - 1) * (CAST(5 AS DOUBLE) / len(w)), 6), b := round(begun + i * (CAST(5 AS DOUBLE) / len(w)), 6))) AS words FROM w),
f AS (
  SELECT DISTINCT chapter, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(w VARCHAR, a DOUBLE, b DOUBLE)[]) AS pending, CAST(NULL AS DOUBLE) AS boundary, CAST([] AS STRUCT(w VARCHAR, a DOUBLE, b DOUBLE)[]) AS told FROM l
  UNION ALL
  SELECT chapter, k2, waiting[settled + 1:], CASE WHEN settled > 0 THEN waiting[settled].b ELSE boundary END, waiting[1:settled]
  FROM (SELECT *, CASE WHEN final THEN len(waiting) ELSE least(len(list_filter(range(1, len(waiting) + 1), lambda i: list_max(list_transform(waiting[1:i], lambda x: x.b)) <= begun + 5 - 2.0)), greatest(len(waiting) - 1, 0)) END AS settled
    FROM (SELECT f.chapter, f.boundary, l.k AS k2, l.final, l.begun, list_concat(list_filter(f.pending, lambda x: x.b < l.begun), list_filter(l.words, lambda x: f.boundary IS NULL OR x.b > f.boundary + 0.12 AND (x.a >= f.boundary - 0.12 OR (x.a + x.b) / 2 > f.boundary))) AS waiting
      FROM f JOIN l ON l.chapter = f.chapter AND l.k = f.k + 1) a) b),
o AS (SELECT chapter, unnest(told) AS x FROM f)
SELECT chapter, x.w AS word, x.a AS start, x.b AS "end" FROM o""")
def timed_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """chapter and committed words: each verse a window of 5 seconds, 4 after the last, its words evenly spread."""
    # columns of their own: inside the words' lambda they would be worked out for each of them
    said = verses(spark, d).withColumn("w", T.words(T.normalize(F.col("text")))).withColumn("step", F.lit(5.0) / F.greatest(F.size("w"), F.lit(1)))
    step, at = F.col("step"), F.col("verse") * 4.0
    timed_words = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.round(at + i * step, 6).alias("start"), F.round(at + (i + 1) * step, 6).alias("end")))
    last = F.max("verse").over(Window.partitionBy("chapter"))
    rows = said.select("chapter", F.col("verse").alias("n"), F.to_json(timed_words).alias("words"), at.alias("window_start"), (at + 5.0).alias("window_end"), (F.col("verse") == last).alias("final"))

    def step_of(s, x):
        import json

        return S.reconcile_step(s, x | {"words": [(y["word"], y["start"], y["end"]) for y in json.loads(x["words"])]})

    return folds.run_batch(rows, "chapter", "n", S.Reconciler, step_of, S.TIMED)


#: SQL of a look of live_windows at the columns start, now2, ref, leader, rounds, committed, read, end_frame and follows.
LOOK = """(SELECT *, CASE WHEN commits AND (follows OR committed = '') AND ahead > 0 AND start < cut AND cut < now2 THEN cut ELSE start END AS start2
  FROM (SELECT *, from2 + least(ahead, 0.6 * (now2 - from2)) AS cut, stable AND ref <> committed AND read >= 6 - 1e-9 AS commits
    FROM (SELECT *, (end_frame + 1) / 50 * (now2 - from2) - 1.0 AS ahead, ref <> '' AND rounds2 >= 2 AS stable
      FROM (SELECT *, greatest(start, now2 - 15.0) AS from2, CASE WHEN ref <> '' AND ref = leader THEN rounds + 1 WHEN ref <> '' THEN 1 ELSE rounds END AS rounds2 FROM {of}) a) b) c)"""
#: SQL of a chunk that is added to the window: whether it ends, is looked at, holds speech, and gives a row; and of the windows that sessions end with.
HEARD = """(SELECT * EXCLUDE (stable, commits), speech AND (ends OR looks AND now2 - start >= 1.2 - 1e-9) AS shows
      FROM (SELECT *, p90 >= greatest(0.004, 2.5 * median, 2.0 * room2) AS speech
        FROM (SELECT *, CASE WHEN NOT ends AND NOT looks THEN room WHEN room = 0 THEN median ELSE least(median, room * 1.02) END AS room2
          FROM (SELECT *, now2 - sounded2 > 1.5 - 1e-9 AS ends, NOT (now2 - sounded2 > 1.5 - 1e-9) AND now2 - looked >= 0.75 - 1e-9 AS looks
            FROM (SELECT f.*, l.k AS k2, l.median, l.p90, l.ref, l.read, l.end_frame, l.follows, f.now + 0.5 AS now2, CASE WHEN l.rms >= 0.012 THEN f.now + 0.5 ELSE f.sounded END AS sounded2
              FROM f JOIN l ON l.session = f.session AND l.k = f.k + 1) x) y) z) v) w"""
LAST = "(SELECT z.* FROM z JOIN ends USING (session, k)) zz"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS session, event_id, abs(value) / 1000 AS level, CASE WHEN event_id % 13 = 0 THEN '' ELSE '1:' || CAST(event_id // 300 AS VARCHAR) END AS ref FROM events),
l AS (SELECT session, row_number() OVER w AS k, round(level * CASE WHEN event_id % 29 < 6 THEN 0.01 ELSE 1.0 END, 9) AS rms, round(level * 0.3, 9) AS median, round(level * CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 1.0 END, 9) AS p90,
  ref, event_id % 9 AS read, event_id % 40 AS end_frame,
  coalesce(CAST(nullif(split_part(ref, ':', 2), '') AS BIGINT) - CAST(nullif(split_part(lag(ref) OVER w, ':', 2), '') AS BIGINT) BETWEEN 0 AND 3, true) AS follows FROM e WINDOW w AS (PARTITION BY session ORDER BY event_id)),
f AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS now, CAST(0 AS DOUBLE) AS looked, CAST(0 AS DOUBLE) AS sounded, CAST(0 AS DOUBLE) AS room, '' AS leader, 0 AS rounds, '' AS committed,
    false AS shown, false AS final, '' AS told, false AS stable, false AS commits, CAST(0 AS DOUBLE) AS seconds, CAST(0 AS DOUBLE) AS advanced FROM l
  UNION ALL
  SELECT session, k2, CASE WHEN ends THEN now2 WHEN shows THEN start2 ELSE start END, now2, CASE WHEN ends OR looks AND (NOT speech OR shows) THEN now2 ELSE looked END, CASE WHEN ends THEN now2 ELSE sounded2 END, room2,
    CASE WHEN ends THEN '' WHEN shows AND ref <> '' THEN ref ELSE leader END, CASE WHEN ends THEN 0 WHEN shows THEN rounds2 ELSE rounds END, CASE WHEN shows AND commits2 THEN ref ELSE committed END,
    shows, ends, ref, stable2, commits2, now2 - from2, start2 - start
  FROM (SELECT * EXCLUDE (stable, commits), stable AS stable2, commits AS commits2
    FROM {LOOK.format(of=HEARD)} u) t),
z AS (SELECT f.* EXCLUDE (stable, commits), f.now AS now2, l.ref, l.read, l.end_frame, l.follows FROM f JOIN l USING (session, k)
  WHERE f.now > f.start AND l.p90 >= greatest(0.004, 2.5 * l.median, 2.0 * CASE WHEN f.room = 0 THEN l.median ELSE least(l.median, f.room * 1.02) END)
  QUALIFY f.k = max(f.k) OVER (PARTITION BY session)),
ends AS (SELECT session, max(k) AS k FROM f GROUP BY session)
SELECT session, final, told AS ref, stable, commits AS committed, round(seconds, 6) AS seconds, round(advanced, 6) AS advanced FROM f WHERE shown
UNION ALL
SELECT session, true, ref, stable, commits, round(now2 - from2, 6), round(start2 - start, 6) FROM {LOOK.format(of=LAST)}""")
def live_windows(spark: SparkSession, d: str) -> DataFrame:
    """session and the windows listened to: events as half seconds of sound with what a recogniser would say of them."""
    e = events(spark, d)
    level = F.abs(F.col("value")) / 1000
    k = F.col("event_id")
    ref = F.when(k % 13 == 0, "").otherwise(T.ref_key(F.lit(1), F.floor(k / 300)))
    rows = e.select(F.col("user_id").alias("session"), k.alias("n"), F.lit(0.5).alias("seconds"), F.round(level * F.when(k % 29 < 6, 0.01).otherwise(1.0), 9).alias("rms"), F.lit(100).alias("frames"), F.round(level * 0.3, 9).alias("median"), F.round(level * F.when(k % 5 == 0, 0.5).otherwise(1.0), 9).alias("p90"),
                    ref.alias("ref"), (k % 9).cast("int").alias("read"), F.lit(10).alias("words"), (k % 40).cast("int").alias("end_frame"), F.lit(50).alias("all_frames"))
    before = F.lag("ref").over(Window.partitionBy("session").orderBy("n"))
    c = live.LiveConfig()
    return folds.run_batch(rows.withColumn("follows", T.is_continuation(before, F.col("ref"))), "session", "n", live.Live, lambda s, x: live.live_step(s, x, c), live.LIVE, lambda s: live.live_flush(s, c))


@query()
def final_sequence(spark: SparkSession, d: str) -> DataFrame:
    """session, refs, confidence: events as cycles of candidates, and what they come to at the end."""
    k = F.col("event_id")
    option = lambda j: F.struct(T.ref_key(F.lit(1) + F.when(F.lit(j) == 2, 1).otherwise(0), F.floor(k / 200) + j, F.floor(k / 200) + j + k % 2).alias("ref"), F.round((k * (j + 3) % 97) / 97, 4).alias("score"))
    rows = events(spark, d).select(F.col("user_id").alias("session"), k.alias("n"), F.to_json(F.array(*(option(j) for j in range(3)))).alias("candidates"), F.when(F.col("event_type") == "purchase", T.ref_key(F.lit(1), F.floor(k / 200))).alias("commit"))

    def step(s, x):
        import json

        found = [(o["ref"], o["score"]) for o in json.loads(x["candidates"])]
        return live.hypothesis_step(s, {"candidates": found, "commit": (x["commit"], 0.5) if x["commit"] else None})

    return folds.run_batch(rows, "session", "n", live.Hypotheses, step, live.FINAL, live.hypothesis_flush)


@query("""WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER w AS k, ref, lag(ref) OVER w AS before, score, margin
  FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN '' ELSE '1:' || CAST(event_id // 150 AS VARCHAR) END AS ref, round(least(abs(value) / 100, 1.0), 6) AS score, round((event_id % 20) / 100, 6) AS margin FROM events) x
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, coalesce(CAST(nullif(split_part(ref, ':', 2), '') AS BIGINT) - CAST(nullif(split_part(before, ':', 2), '') AS BIGINT) BETWEEN 1 AND 3, false) AS next FROM e),
f AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS k, '' AS committed, '' AS leader, 0 AS repeats, 0 AS stale, CAST(NULL AS VARCHAR) AS kind, '' AS told, CAST(0 AS DOUBLE) AS score FROM l
  UNION ALL
  SELECT session, k2, CASE WHEN gone THEN '' WHEN commits THEN ref ELSE committed END, ref, CASE WHEN ref = '' THEN 0 ELSE again END,
    CASE WHEN gone OR commits THEN 0 WHEN ref = '' THEN stale + 1 WHEN ref = committed THEN 0 ELSE stale END,
    CASE WHEN gone THEN 'rollback' WHEN ref = '' THEN NULL WHEN commits THEN 'verse_match' ELSE 'verse_candidate' END, CASE WHEN gone THEN committed ELSE ref END, CASE WHEN gone THEN 0 ELSE score2 END
  FROM (SELECT *, ref = '' AND committed <> '' AND stale + 1 >= 4 AS gone,
      ref <> '' AND ref <> committed AND score2 >= CASE WHEN committed <> '' THEN 0.45 ELSE 0.75 END AND NOT (committed <> '' AND NOT follows AND again < 2)
      AND (margin >= CASE WHEN follows THEN 0.06 ELSE 0.12 END OR again >= 2) AS commits
    FROM (SELECT f.*, l.k AS k2, l.ref, l.score AS score2, l.margin, l.next AND f.committed <> '' AS follows, CASE WHEN l.ref = f.leader THEN f.repeats + 1 ELSE 1 END AS again
      FROM f JOIN l ON l.session = f.session AND l.k = f.k + 1) a) b)
SELECT session, kind, told AS ref, score FROM f WHERE kind IS NOT NULL""")
def flush_tracker(spark: SparkSession, d: str) -> DataFrame:
    """session and tracker events: events as recognised refs with scores and margins."""
    ref = F.when(F.col("event_id") % 9 == 0, "").otherwise(T.ref_key(F.lit(1), F.floor(F.col("event_id") / 150)))
    e = events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), ref.alias("ref"), F.round(F.least(F.abs(F.col("value")) / 100, F.lit(1.0)), 6).alias("score"), F.round((F.col("event_id") % 20) / 100, 6).alias("margin"))
    before = F.lag("ref").over(Window.partitionBy("session").orderBy("n"))
    rows = e.withColumn("next", T.is_next(before, F.col("ref")))
    return folds.run_batch(rows, "session", "n", S.Tracker, partial(S.tracker_step), S.TRACKED)


@query()
def track_recitals(spark: SparkSession, d: str) -> DataFrame:
    """session and what is told, provisionally or for good, of conversations read aloud: four words a chunk, every thirteenth misheard, a silence after every third turn."""
    token = lambda w: (F.pmod(F.crc32(w.cast("binary")), F.lit(15)) + 1).cast("int")
    known = verses(spark, d).select("chapter", "verse", T.normalize(F.col("text")).alias("text"))
    known = known.withColumn("tokens", F.transform(T.words(F.col("text")), token))
    said = known.select(F.col("chapter").alias("session"), "verse", F.posexplode(T.words(F.col("text"))).alias("at", "w"))
    said = said.withColumn("w", F.when((F.col("verse") * 31 + F.col("at")) % 13 == 12, F.lit("hm")).otherwise(F.col("w")))
    parts = said.groupBy("session", "verse", F.floor(F.col("at") / 4).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("x"))
    spoken = parts.select("session", (F.col("verse") * 100_000 + F.col("part")).alias("n"), F.lit(1.6).alias("seconds"), F.lit(0.2).alias("rms"), F.transform("x", lambda x: x["w"]).alias("words"))
    still = known.where("verse % 3 = 2").select(F.col("chapter").alias("session"), (F.col("verse") * 100_000 + 99_999).alias("n"), F.lit(1.5).alias("seconds"), F.lit(0.0).alias("rms"), F.array().cast("array<string>").alias("words"))
    rows = tracking.with_near_once(united(spoken, still), known)
    frame = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i == k, F.lit(-0.05)).otherwise(F.lit(-6.0)).cast("float"))
    return tracking.track(rows, late={"frames": F.flatten(F.transform("words", lambda w: F.array(frame(F.lit(0)), frame(token(w)))))})


def token_of(word):
    return (F.pmod(F.crc32(word.cast("binary")), F.lit(997)) + 1).cast("int")


@query()
def offline_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """clip and its measures: every turn as a clip of which a chapter's share of words is misheard, transcribed in windows and set against its words."""
    from spanloom.operators import choices

    clip = (F.col("chapter") * 1000 + F.col("verse")).cast("long")
    said = verses(spark, d).select(clip.alias("session"), "chapter", F.posexplode(T.words(T.normalize(F.col("text")))).alias("at", "w"))
    heard = F.when(F.col("at") % 20 < F.col("chapter") % 5, F.lit(998)).otherwise(token_of(F.col("w")))
    frames = said.select("session", "at", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (heard if k < 3 else F.lit(0)).alias("token")) for k in range(4)))).alias("f"))
    rows = frames.select("session", (F.col("at") * 4 + F.col("f.k")).alias("n"), F.lit(0.08).alias("seconds"), F.col("f.token").alias("token"), F.lit(False).alias("pause"))
    words = transcribe.transcribed(rows, {k: f"\u2581w{k}" for k in range(1, 999)}, 0).withColumnRenamed("session", "clip")
    references = said.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("at", token_of(F.col("w")).alias("t")))).alias("w")).select(F.col("session").alias("clip"), F.array_join(F.transform("w", lambda x: F.concat(F.lit("w"), x["t"].cast("string"))), " ").alias("text"))
    return choices.accuracy(words, references).select("clip", *(F.round(c, 6).alias(c) for c in ("f1", "precision", "recall", "rate")), "reference_words", "hypothesis_words", "passed")


@query()
def windowed_words(spark: SparkSession, d: str) -> DataFrame:
    """session, word, start, end: conversations as frames of 0.08 seconds, a word three frames and a blank, in windows of 30 seconds, overlapping or cut after every fifth turn."""
    said = verses(spark, d).select(F.col("chapter").alias("session"), "verse", F.posexplode(T.words(T.normalize(F.col("text")))).alias("at", "w"))
    last = F.max("at").over(Window.partitionBy("session", "verse"))
    said = said.withColumn("cut", (F.col("verse") % 5 == 4) & (F.col("at") == last))
    token = token_of(F.col("w"))
    frames = said.select("session", (F.col("verse") * 1_000_000 + F.col("at") * 4).alias("n"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), token.alias("token")) for k in range(3)), F.struct(F.lit(3).alias("k"), F.lit(0).alias("token")))).alias("f"), "cut")
    rows = frames.select("session", (F.col("n") + F.col("f.k")).alias("n"), F.lit(0.08).alias("seconds"), F.col("f.token").alias("token"), (F.col("cut") & (F.col("f.k") == 3)).alias("pause"))
    out = transcribe.transcribed(rows, {k: f"\u2581w{k}" for k in range(1, 998)}, 0)
    return out.select("session", "word", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("""WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'F' AS again, o_orderpriority AS text FROM orders),
m AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS first FROM lineitem GROUP BY 1)
SELECT d.id, CASE WHEN again THEN upper(text) || '!' ELSE text END AS text, row_number() OVER (ORDER BY d.id) AS display_sequence,
       CAST(CASE WHEN again THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN again THEN coalesce(first, 0) ELSE coalesce(n, 0) END AS n_matches
FROM d LEFT JOIN m ON m.id = d.id""")
def saved_in_versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders saved as records with their lines, those that are done a second time, and that batch once more: records, revisions and matches of the last version."""
    from spanloom.operators import store
    from spanloom.operators.deal import checkpoint_folder
    from spanloom.sources.versions import Versions

    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderstatus")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").cast("int").alias("ordinal"), F.col("l_partkey").cast("int").alias("chapter"), F.col("l_suppkey").cast("int").alias("verse"))
    again = o.where("o_orderstatus = 'F'").withColumn("text", F.concat(F.upper("text"), F.lit("!")))
    versions = Versions(spark, f"{checkpoint_folder(spark)}/versions-{uuid.uuid4().hex}")
    for number, drafts, matches in ((0, o, lines), (1, again, lines.where("ordinal = 1")), (1, again, lines)):
        versions.update(lambda tables, drafts=drafts, matches=matches: store.saved_records(tables, drafts, matches, ["en"]), ("orders", number))
    n = versions.table("matches").groupBy("id").agg(F.count("*").alias("n_matches"))
    revision = versions.table("jobs").select("id", "revision")
    return versions.table("records").join(revision, "id").join(n, "id", "left").select("id", "text", "display_sequence", "revision", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, round(abs(value), 6) AS rms FROM events),
t AS (SELECT user_id, greatest(1e-5, list_sort(list(rms))[count(*) // 2 + 1] * 0.4) AS t, max(rms) AS m, max(n) * CAST(0.2 AS DOUBLE) AS total FROM e GROUP BY 1),
q AS (SELECT e.user_id, n, n - row_number() OVER (PARTITION BY e.user_id ORDER BY n) AS g FROM e JOIN t ON e.user_id = t.user_id WHERE rms < t AND m >= 1e-5),
r AS (SELECT user_id, min(n) AS first, max(n) AS last FROM q GROUP BY user_id, g HAVING (max(n) - min(n) + 1) * 0.2 >= 0.4 - 1e-9),
l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS k, (first + last + 1) / 2 * CAST(0.2 AS DOUBLE) AS middle FROM r),
f AS (
  SELECT user_id, CAST(total AS DOUBLE) AS total, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS began, false AS cut FROM t
  UNION ALL
  SELECT user_id, total, k2, CASE WHEN cuts THEN middle ELSE last END, last, cuts
  FROM (SELECT f.*, l.k AS k2, l.middle, l.middle - f.last >= 2.0 AND f.total - l.middle >= 1.0 AS cuts FROM f JOIN l ON l.user_id = f.user_id AND l.k = f.k + 1) a)
SELECT user_id, began AS start, last AS "end" FROM f WHERE cut
UNION ALL
SELECT user_id, last, total FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1) z WHERE total > last""")
def audio_segments(spark: SparkSession, d: str) -> DataFrame:
    """user_id, start, end: each user's events as frames of 0.2 seconds, cut at pauses."""
    from spanloom.operators import choices

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = events(spark, d).select("user_id", n.cast("long").alias("n"), F.round(F.abs("value"), 6).alias("rms"))
    total = e.groupBy("user_id").agg((F.max("n") * 0.2).alias("total"))
    p = choices.pauses(e, "user_id", 0.2, 0.4, 0.4).select("user_id", F.col("first").alias("n"), "middle").join(total, "user_id")
    end = total.select("user_id", F.lit(1 << 40).alias("n"), F.lit(None).cast("double").alias("middle"), "total")
    return folds.run_batch(united(p.select("user_id", "n", "middle", "total"), end), "user_id", "n", S.Cutter, S.cut_step, S.CUT)


@query("""WITH j AS (SELECT event_id, event_id % 11 = 0 AS missing, CASE WHEN event_id % 5 = 0 THEN 'text' END AS curated, CASE WHEN event_id % 7 = 0 THEN 'text' END AS cached, CASE event_type WHEN 'click' THEN 'modelMissing' WHEN 'view' THEN 'network' END AS error FROM events)
SELECT event_id, CASE WHEN missing THEN 'failed' WHEN curated IS NOT NULL OR cached IS NOT NULL THEN 'done' WHEN error = 'modelMissing' THEN 'pending' WHEN error IS NOT NULL THEN 'failed' ELSE 'done' END AS state FROM j""")
def job_outcome(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import store

    e = events(spark, d)
    k = F.col("event_id")
    error = F.when(F.col("event_type") == "click", "modelMissing").when(F.col("event_type") == "view", "network")
    state = store.job_outcome(k % 11 == 0, F.when(k % 5 == 0, "text"), F.when(k % 7 == 0, "text"), error)
    return e.select("event_id", state.alias("state"))


@query("""WITH j AS (SELECT event_id, event_type AS state, CAST(event_id % 3 AS INTEGER) AS attempts, user_id FROM events)
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'pending' ELSE state END AS state, CAST(CASE WHEN user_id % 10 = 0 THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts FROM j""")
def job_requeue(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators import store

    jobs = events(spark, d).select("event_id", F.col("event_type").alias("state"), (F.col("event_id") % 3).cast("int").alias("attempts"), "user_id")
    return store.requeued(jobs, F.col("user_id") % 10 == 0).drop("user_id")
