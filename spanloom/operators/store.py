"""A keyed record store on tables: every change gives the new table, to be written by the caller.

Stock Parquet tables have no MERGE: read, change, write aside, swap. Changes of several tables at once (``saved_records`` and those after it)
are for sources.versions, which commits them together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.deal import kept, united


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by order."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming replaces stored rows of its keys; the rest stays."""
    return united(stored.join(incoming.select(*keys).distinct(), keys, "left_anti"), incoming)


def save(stored: DataFrame, drafts: DataFrame, keys: list[str], sequence: str = "display_sequence", at: str = "at") -> DataFrame:
    """Idempotent save of drafts (no sequence): known keys keep their number, new ones follow the greatest in order of keys.

    Of drafts with one key the last by at counts. New rows are numbered partition by partition, with
    only the partitions' counts added up in one place. They are written first: read twice, they could be dealt out in two ways, and rows of
    partitions that the counts don't know would be lost.
    """
    new = latest(drafts, keys, at)
    known = new.join(stored.select(*keys, sequence), keys)
    fresh = new.join(stored.select(*keys), keys, "left_anti")
    placed = kept(fresh.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    inside = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    before = inside.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    most = stored.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("_most"))
    # one row of the greatest number, and one per partition
    numbered = inside.join(F.broadcast(before), "_p").join(F.broadcast(most), F.lit(True)).withColumn(sequence, (F.col("_most") + F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before", "_most")
    return upsert(stored, united(known, numbered), keys)


def guarded(incoming: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Late results whose id, revision and language are still current."""
    return incoming.join(current.select(*keys).distinct(), keys, "left_semi")


def without(children: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """What a delete with its cascade leaves."""
    return children.join(gone.select(*keys).distinct(), keys, "left_anti")


def changed(rows: DataFrame, where: Column, **new: Column) -> DataFrame:
    """A conditional update; columns keep their place."""
    return rows.select(*(F.when(where, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart running jobs are pending again."""
    return changed(jobs, F.col("state") == "running", state=F.lit("pending"))


def hydrated(records: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """records with each child table nested as an ordered array; children are gathered before they are joined, so they don't multiply."""
    for name, child in children.items():
        nested = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in child.columns if c != key)))).alias(name))
        records = records.join(nested, key, "left").withColumn(name, F.coalesce(name, F.filter(F.array(F.struct(*(F.lit(None).cast(child.schema[c].dataType).alias(c) for c in child.columns if c != key))), lambda x: F.lit(False))))
    return records


def page(records: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    return records.orderBy(*order).offset(offset).limit(limit)


def curated(needs: DataFrame, texts: DataFrame, record: str, verse: list[str]) -> DataFrame:
    """record, text: the ordered texts of a record's verses, if every one has a text. needs have record, ordinal and the verse's key."""
    joined = needs.join(texts, verse, "left").groupBy(record).agg(F.bool_and(F.col("text").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("t"))
    return joined.where("all").select(record, F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def picked(rows: DataFrame, keys: list[str], at: str, state: str = "state") -> DataFrame:
    """Of each key the last row that is done, else the last row."""
    by = Window.partitionBy(*keys).orderBy(F.desc(F.col(state) == "done"), F.desc(at))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def source_of(matches: Column, curated_text: Column, whole: Column) -> Column:
    """struct(source, scope) of a translation's text."""
    source = F.when(matches == 0, "machineAsr").when(curated_text.isNotNull(), "curatedEdition").otherwise("machineCanonical")
    scope = F.when(matches == 0, "asr").when(whole, "fullVerses").when(curated_text.isNotNull(), "fullVerseContext").otherwise("confirmedRange")
    return F.struct(source.alias("source"), scope.alias("scope"))


def job_outcome(missing: Column, curated_text: Column, cached: Column, error: Column) -> Column:
    """State of a translation job: a missing record fails it; curated or cached text ends it; a model that may still come leaves it pending."""
    waits = error.isin("modelMissing", "offlineDownloadUnavailable")
    return F.when(missing, "failed").when(curated_text.isNotNull() | cached.isNotNull(), "done").when(waits, "pending").when(error.isNotNull(), "failed").otherwise("done")


def requeued(jobs: DataFrame, record: Column) -> DataFrame:
    """Jobs of the chosen records are pending again, with one more attempt."""
    return changed(jobs, record, state=F.lit("pending"), attempts=F.col("attempts") + 1)


def touched(cache: DataFrame, hits: DataFrame, at: Column) -> DataFrame:
    """A cache after its entries were read: those hit are used last at a time."""
    seen = hits.select("cache_key").distinct().withColumn("_h", F.lit(True))
    return cache.join(seen, "cache_key", "left").withColumn("last_used_at", F.when(F.col("_h"), at).otherwise(F.col("last_used_at"))).select(cache.columns)


def by_id(records: DataFrame, value, key: str = "id") -> DataFrame:
    return records.where(F.col(key) == value)


def pending(jobs: DataFrame, most: int = 20, state: str = "state", at: str = "created_at", key: str = "id") -> DataFrame:
    """The oldest jobs that are to be done, as many as asked."""
    return jobs.where(F.col(state).isin("pending", "running")).orderBy(at, key).limit(most)


def cleared(records: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """The tables after everything was deleted: numbers begin anew, caches aren't among them."""
    return tuple(t.where("false") for t in (records, *children))


def saved_matches(children: DataFrame, drafts: DataFrame, key: str) -> DataFrame:
    """A child table after its records were saved again: the saved records' rows are replaced as a whole, even by none (a draft's row with a null ordinal)."""
    return united(children.join(drafts.select(key).distinct(), key, "left_anti"), drafts.where("ordinal is not null"))


def retried(jobs: DataFrame, failed: Column, wanted: Column) -> DataFrame:
    """Failed jobs that are wanted again are pending, with one more attempt; others stay."""
    return requeued(jobs, failed & wanted)


def with_language(records: DataFrame, record: Column, language: str, targets: str = "targets") -> DataFrame:
    """Records with one more target language, at the end and only once."""
    added = F.when(F.array_contains(targets, language), F.col(targets)).otherwise(F.array_append(targets, F.lit(language)))
    return changed(records, record, **{targets: added})


def still_current(results: DataFrame, current: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Results made for the version of a key that is current now; later ones for what came before are dropped."""
    return results.join(current.select(*keys, version), [*keys, version], "left_semi")


RECORD, MATCH, JOB, DONE = "id string, text string, at timestamp, display_sequence long", "id string, ordinal int, chapter int, verse int", "id string, language string, revision long, state string, attempts int", "id string, language string, revision long, text string"


def saved_records(tables: Callable[..., DataFrame], drafts: DataFrame, matches: DataFrame, languages: list[str]) -> dict[str, DataFrame]:
    """A change of all tables that saving records means: records keep or get their number, their matches are replaced, and a job waits for each language.

    drafts are (id, text, at), matches (id, ordinal, chapter, verse). A record saved again gets a new revision, its number of jobs so far, so
    that what is still on its way for the old text comes too late.
    """
    records, known, jobs = tables("records", RECORD), tables("matches", MATCH), tables("jobs", JOB)
    new = save(records, drafts.select("id", "text", "at"), ["id"])
    before = jobs.groupBy("id", "language").agg(F.max("revision").alias("revision"))
    asked = drafts.select("id").distinct().crossJoin(F.broadcast(drafts.sparkSession.createDataFrame([(x,) for x in languages], "language string")))
    waiting = asked.join(before, ["id", "language"], "left").select("id", "language", (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"))
    return {"records": new.select("id", "text", "at", "display_sequence"), "matches": saved_matches(known, drafts.select("id").distinct().join(matches, "id", "left"), "id"), "jobs": upsert(jobs, waiting, ["id", "language"])}


def finished_jobs(tables: Callable[..., DataFrame], results: DataFrame, most: int = 3) -> dict[str, DataFrame]:
    """A change of jobs and translations by results (id, language, revision, text, error): only those of a job's present revision count.

    A text ends its job and replaces the translation; an error puts the job back, after as many attempts it fails.
    """
    jobs, done = tables("jobs", JOB), tables("translations", DONE)
    current = still_current(results, jobs.where(F.col("state").isin("pending", "running")), ["id", "language"], "revision")
    joined = jobs.join(current.select("id", "language", "revision", F.col("text").isNotNull().alias("_done")), ["id", "language", "revision"], "left")
    tried = F.col("attempts") + F.when(F.col("_done").isNull(), 0).otherwise(1)
    state = F.when(F.col("_done").isNull(), F.col("state")).when(F.col("_done"), "done").when(tried >= most, "failed").otherwise("pending")
    texts = current.where("text is not null").select("id", "language", "revision", "text")
    return {"jobs": joined.select("id", "language", "revision", state.alias("state"), tried.cast("int").alias("attempts")), "translations": upsert(done, texts, ["id", "language"])}


def deleted_records(tables: Callable[..., DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """A change of all tables that deleting records means."""
    kinds = {"records": RECORD, "matches": MATCH, "jobs": JOB, "translations": DONE}
    return {name: without(tables(name, schema), gone, ["id"]) for name, schema in kinds.items()}
