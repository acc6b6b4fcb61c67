"""Files of a corpus as tables, with the checks that a load must pass, and tables as files."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import file_range

VERSE = "surah int, ayah int, text_uthmani string, text_clean string, surah_name string, surah_name_en string"
RATE = 16_000


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token_id, token_text of a JSON object from ids to tokens; ids that are no numbers are left out."""
    pairs = whole(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "token_text"))
    return pairs.select(F.expr("try_cast(k AS int)").alias("token_id"), "token_text").where("token_id is not null")


def verses(spark: SparkSession, path: str) -> DataFrame:
    """chapter, verse, text and names of a JSON array of verses; a verse without plain text has its written one."""
    rows = spark.read.schema(VERSE).option("multiLine", True).json(path)
    text = F.coalesce(F.nullif(F.col("text_clean"), F.lit("")), F.col("text_uthmani"))
    return rows.select(F.col("surah").alias("chapter"), F.col("ayah").alias("verse"), text.alias("text"), F.col("text_uthmani").alias("written"), F.col("surah_name").alias("chapter_name"), F.col("surah_name_en").alias("chapter_name_en"))


def span_tokens(spark: SparkSession, path: str) -> DataFrame:
    """chapter, first, last, tokens of a JSON object from chapter:first:last to token ids."""
    pairs = whole(spark, path).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("k", "tokens"))
    part = lambda i: F.expr(f"try_cast(split_part(k, ':', {i}) AS int)")
    return pairs.select(part(1).alias("chapter"), part(2).alias("first"), part(3).alias("last"), "tokens").where("last is not null")


def delimited(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """chapter, verse, text of lines chapter|verse|text; blank lines and comments are skipped, later bars belong to the text."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.split("value", "[|]", 3).alias("p")).where("size(p) = 3")
    rows = lines.select(F.expr("try_cast(p[0] AS int)").alias("chapter"), F.expr("try_cast(p[1] AS int)").alias("verse"), F.expr("p[2]").alias("text"))
    return counted(rows, expected) if expected is not None else rows


def counted(rows: DataFrame, expected: int) -> DataFrame:
    """rows, if there are as many as declared; otherwise the load fails."""
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} rows, {expected} declared")
    return rows


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chapters and verses of a nested corpus file, checked against its manifest's counts. Names fall back to the chapter's number."""
    schema = f"manifest struct<verseCount:string,surahCount:string>, chapters array<struct<surah:int,nameArabic:string,nameEnglish:string,ayahCount:int>>, verses array<struct<{', '.join(c.strip().replace(' ', ':') for c in VERSE.split(', '))}>>"
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    chapters = document.select(F.explode("chapters").alias("c")).select(F.col("c.surah").alias("chapter"), F.coalesce("c.nameArabic", F.col("c.surah").cast("string")).alias("name"), F.col("c.nameEnglish").alias("name_en"), F.col("c.ayahCount").alias("verses"))
    rows = document.select(F.explode("verses").alias("v")).select(F.col("v.surah").alias("chapter"), F.col("v.ayah").alias("verse"), F.coalesce(F.nullif(F.col("v.text_clean"), F.lit("")), F.col("v.text_uthmani")).alias("text"))
    told = document.select(F.expr("coalesce(try_cast(manifest.verseCount AS int), 0)").alias("v"), F.expr("coalesce(try_cast(manifest.surahCount AS int), 0)").alias("c")).first()
    counted(rows, told["v"])
    counted(chapters, told["c"])
    named = rows.join(chapters.select("chapter", "name"), "chapter", "left").withColumn("name", F.coalesce("name", F.col("chapter").cast("string")))
    return chapters, named


def uneven_chapters(chapters: DataFrame, rows: DataFrame) -> DataFrame:
    """Chapters whose number of verses isn't what is declared."""
    found = rows.groupBy("chapter").agg(F.count("*").alias("found"))
    return chapters.join(found, "chapter", "left").where("verses <> coalesce(found, 0)").select("chapter", "verses", F.coalesce("found", F.lit(0)).alias("found"))


def picked_editions(index: DataFrame, preferred: list[str]) -> DataFrame:
    """One edition per language: preferred ones first, then by place in the index. An edition without a granted licence stops the load."""
    at = F.array_position(F.array(*map(F.lit, preferred)).cast("array<string>"), F.col("edition"))
    order = Window.partitionBy("language").orderBy(F.when(at > 0, at).otherwise(len(preferred) + 1), "position")
    chosen = index.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return chosen.withColumn("licence", F.when(F.col("licence") == "granted", F.col("licence")).otherwise(F.raise_error(F.concat(F.lit("no licence for "), F.col("edition")))))


def edition_texts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """chapter, verse, text of a nested edition for the wanted verses; missing ones stop the load."""
    chapters = spark.read.schema("chapters array<struct<id:int,verses:array<struct<id:int,text:string>>>>").option("multiLine", True).json(path).select(F.explode("chapters").alias("c"))
    rows = chapters.select(F.col("c.id").alias("chapter"), F.explode("c.verses").alias("v")).select("chapter", F.col("v.id").alias("verse"), F.col("v.text").alias("text")).join(wanted, ["chapter", "verse"], "left_semi")
    if missing := wanted.join(rows.where("trim(text) <> ''"), ["chapter", "verse"], "left_anti").limit(5).collect():
        raise ValueError(f"no text for {[tuple(r) for r in missing]}")
    return rows


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files: what a manifest lists."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def decoded_wav(data: bytes) -> np.ndarray:
    """Samples of a RIFF file of 16 kHz, one channel, 16 bits, as floats; chunks are padded to even lengths. Anything else is an error."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            if form is None or form[0] != 1 or form[1] != 1 or form[2] != RATE or form[5] != 16:
                raise ValueError(f"not 16 kHz mono 16-bit PCM: {form}")
            return pcm16(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pcm16(data: bytes) -> np.ndarray:
    """Little-endian 16-bit samples as floats; an odd last byte is dropped."""
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768


def sounds(spark: SparkSession, path: str) -> DataFrame:
    """path, samples, seconds of wave files."""
    @F.pandas_udf("array<float>")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(decoded_wav)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", decode("content").alias("samples")).withColumn("seconds", F.size("samples") / RATE)


def reference_text(candidates: DataFrame) -> DataFrame:
    """Of (item, priority, text) the first text of each item that isn't blank; an item without one is an error."""
    order = Window.partitionBy("item").orderBy(F.when(F.trim("text") != "", 0).otherwise(1), "priority")
    best = candidates.withColumn("n", F.row_number().over(order)).where("n = 1")
    text = F.when(F.coalesce(F.trim("text"), F.lit("")) != "", F.trim("text")).otherwise(F.raise_error(F.concat(F.lit("no reference text for "), F.col("item").cast("string"))))
    return best.select("item", text.alias("text"))


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object a line."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def latest_events(events: DataFrame, kind: str | None = None, most: int = 4096) -> DataFrame:
    """The last events by seq that a bounded trace still holds, of one kind if asked."""
    kept = events.orderBy(F.desc("seq")).limit(most)
    return kept if kind is None else kept.where(F.col("kind") == kind)


def capped(chunks: DataFrame, most_bytes: int) -> DataFrame:
    """Chunks (session, n, content) up to the first that would pass the cap of its session: the sink stops, it doesn't cut."""
    total = F.sum(F.octet_length("content")).over(Window.partitionBy("session").orderBy("n"))
    return chunks.withColumn("total", total).where(F.col("total") <= most_bytes).drop("total")


EDITION = "languageId string, displayName string, editionId string, publisher string, version string, source string, license string, licenseUrl string, file string"


def translations(spark: SparkSession, path: str) -> DataFrame:
    """The editions that a catalog lists, one a language (the last of equals), with the verses they should have (0 if that isn't a number)."""
    schema = f"verseCount string, editions array<struct<{', '.join(c.replace(' ', ':') for c in EDITION.split(', '))}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.expr("coalesce(try_cast(verseCount AS int), 0)").alias("verses"), F.posexplode("editions").alias("position", "e"))
    last = Window.partitionBy("languageId").orderBy(F.desc("position"))
    return rows.select("e.*", "verses", "position").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "position")


def translated_verses(spark: SparkSession, folder: str) -> DataFrame:
    """language, chapter, verse, text of the files of a folder, each named after its language; a filter on language reads that file alone."""
    pairs = whole(spark, folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("language"), F.explode(F.from_json("value", "verses map<string,string>")["verses"]).alias("k", "text"))
    part = lambda i: F.expr(f"try_cast(split_part(k, ':', {i}) AS int)")
    return pairs.select("language", part(1).alias("chapter"), part(2).alias("verse"), "text").where("verse is not null")


def store_translations(verses: DataFrame, path: str) -> None:
    """The same as a table with a folder for each language, which a filter on language prunes to."""
    verses.write.partitionBy("language").parquet(path)


def available_keys(verses: DataFrame, language: str) -> DataFrame:
    """chapter, verse: what a language's edition has."""
    return verses.where(F.col("language") == language).select("chapter", "verse").distinct()


def write_corpus(chapters: DataFrame, verses: DataFrame, path: str, version: str) -> None:
    """A folder of the verses and chapters as JSON, a record a line, and a manifest with their counts and every file's bytes and SHA-256."""
    spark = verses.sparkSession
    for name, table in (("verses", verses), ("chapters", chapters)):
        table.write.json(f"{path}/{name}")
    files = digests(spark, f"{path}/verses").unionByName(digests(spark, f"{path}/chapters")).where("not startswith(element_at(split(path, '/'), -1), '_')")
    listed = files.agg(F.array_sort(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256"))).alias("files"))
    counts = verses.agg(F.count("*").cast("string").alias("verseCount")).crossJoin(chapters.agg(F.count("*").cast("string").alias("surahCount")))  # a row each
    listed.crossJoin(counts).withColumn("corpusVersion", F.lit(version)).write.json(f"{path}/manifest")


CLIP = "file string, surah int, ayahStart int, ayahEnd int, includesBismillah boolean"


def clips(spark: SparkSession, manifest: str, folder: str | None = None) -> DataFrame:
    """item, chapter, first, last, opening, reference of the built-in clips, then of a folder's sound files.

    Entries of the manifest without a file or range are skipped. A sound file has its text beside it (reference is that file), or its range in
    its name; one with neither is skipped.
    """
    listed = spark.read.schema(CLIP).option("multiLine", True).option("mode", "DROPMALFORMED").json(manifest).where("file is not null and surah is not null and ayahStart is not null and ayahEnd is not null")
    known = listed.select(F.col("file").alias("item"), F.col("surah").alias("chapter"), F.col("ayahStart").alias("first"), F.col("ayahEnd").alias("last"), F.coalesce("includesBismillah", F.lit(True)).alias("opening"), F.lit(None).cast("string").alias("reference"))
    if folder is None:
        return known
    files = spark.read.format("binaryFile").load(folder).select("path", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("kind"))
    texts = whole(spark, f"{folder}/*.txt").select(F.regexp_replace(F.col("_metadata.file_path"), r"\.[^./]*$", "").alias("stem"), F.col("value")).where("trim(value) <> ''") if files.where("kind = 'txt'").limit(1).count() else files.where("false").select("stem", F.lit("").alias("value"))
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    found = files.where("kind = 'wav'").withColumn("stem", plain(F.col("stem"))).join(texts.select(plain(F.col("stem")).alias("stem"), F.lit(True).alias("told")), "stem", "left")
    found = found.withColumn("r", file_range(F.element_at(F.split("path", "/"), -1))).where("told or r is not null")
    mine = found.select(plain(F.col("path")).alias("item"), F.when(F.col("told").isNull(), F.col("r.chapter")).alias("chapter"), F.when(F.col("told").isNull(), F.col("r.first")).alias("first"), F.when(F.col("told").isNull(), F.col("r.last")).alias("last"), F.lit(True).alias("opening"), F.when(F.col("told"), F.concat("stem", F.lit(".txt"))).alias("reference"))
    return known.unionByName(mine)
