"""Sources and sinks over small files."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.sources import files


def put(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_vocabulary_and_span_tokens(spark, tmp_path):
    v = files.vocabulary(spark, put(tmp_path / "v.json", {"0": "<unk>", "5": "<blank>", "x": "no"}))
    assert sorted(map(tuple, v.collect())) == [(0, "<unk>"), (5, "<blank>")]
    s = files.span_tokens(spark, put(tmp_path / "s.json", {"1:1:2": [1, 2, 3], "bad": [9]}))
    assert [tuple(r) for r in s.collect()] == [(1, 1, 2, [1, 2, 3])]


def test_verses_fall_back_to_the_written_text(spark, tmp_path):
    rows = [{"surah": 1, "ayah": 2, "text_uthmani": "W", "text_clean": ""}, {"surah": 1, "ayah": 1, "text_uthmani": "W", "text_clean": "c"}]
    assert [(r["verse"], r["text"]) for r in files.verses(spark, put(tmp_path / "v.json", rows)).orderBy("verse").collect()] == [(1, "c"), (2, "W")]


def test_delimited_lines_and_their_count(spark, tmp_path):
    path = put(tmp_path / "c.txt", "# head\n\n1|1|one|more\n1|2|two\nnonsense\n")
    assert [tuple(r) for r in files.delimited(spark, path, 2).orderBy("verse").collect()] == [(1, 1, "one|more"), (1, 2, "two")]
    with pytest.raises(ValueError, match="declared"):
        files.delimited(spark, path, 3)


def document(count):
    return {"manifest": {"verseCount": count, "surahCount": 1}, "chapters": [{"surah": 1, "nameEnglish": "First", "ayahCount": 2}], "verses": [{"surah": 1, "ayah": 1, "text_clean": "a"}, {"surah": 1, "ayah": 2, "text_uthmani": "b"}]}


def test_corpus_counts(spark, tmp_path):
    chapters, rows = files.corpus(spark, put(tmp_path / "a.json", document(2)))
    assert sorted((r["verse"], r["text"], r["name"]) for r in rows.collect()) == [(1, "a", "1"), (2, "b", "1")]
    assert files.uneven_chapters(chapters, rows.where("verse = 1")).count() == 1
    with pytest.raises(ValueError, match="declared"):
        files.corpus(spark, put(tmp_path / "b.json", document("3")))


def test_editions(spark, tmp_path):
    index = spark.createDataFrame([("en", "x", 1, "granted"), ("en", "y", 2, "granted"), ("de", "z", 3, "asked")], "language string, edition string, position int, licence string")
    assert [r["edition"] for r in files.picked_editions(index.where("language = 'en'"), ["y"]).collect()] == ["y"]
    with pytest.raises(Exception, match="no licence for z"):
        files.picked_editions(index, []).collect()
    wanted = spark.createDataFrame([(1, 1)], "chapter int, verse int")
    path = put(tmp_path / "e.json", {"chapters": [{"id": 1, "verses": [{"id": 1, "text": "t"}, {"id": 2, "text": "u"}]}]})
    assert [tuple(r) for r in files.edition_texts(spark, path, wanted).collect()] == [(1, 1, "t")]
    with pytest.raises(ValueError, match="no text"):
        files.edition_texts(spark, path, wanted.unionAll(spark.createDataFrame([(9, 9)], "chapter int, verse int")))


def wav(rate=files.RATE, channels=1, extra=b"LIST\x03\x00\x00\x00abc\x00"):
    samples = struct.pack("<3h", 0, 16384, -32768)
    body = b"WAVE" + b"fmt \x10\x00\x00\x00" + struct.pack("<HHIIHH", 1, channels, rate, rate * 2, 2, 16) + extra + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wave_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav())
    row = files.sounds(spark, str(tmp_path)).first()
    assert row["samples"] == [0.0, 0.5, -1.0] and row["seconds"] == 3 / 16000
    for bad in (wav(rate=8000), wav(channels=2), b"nothing", wav()[:40]):
        with pytest.raises(ValueError, match="not|no data"):
            files.decoded_wav(bad)
    assert np.array_equal(files.pcm16(b"\x00\x40\x01"), np.array([0.5], np.float32))
    assert files.digests(spark, str(tmp_path / "a.wav")).first()["bytes"] == len(wav())


def test_reference_text_and_traces(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, " "), (1, 2, " b "), (1, 3, "c"), (2, 1, None)], "item int, priority int, text string")
    assert files.reference_text(rows.where("item = 1")).first()["text"] == "b"
    with pytest.raises(Exception, match="no reference text for 2"):
        files.reference_text(rows).collect()
    trace = spark.range(10).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    assert sorted(r["seq"] for r in files.latest_events(trace, "odd", 4).collect()) == [7, 9]
    files.write_events(trace, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 10
    chunks = spark.createDataFrame([("s", k, b"abcd") for k in range(5)], "session string, n int, content binary")
    assert [r["n"] for r in files.capped(chunks, 10).orderBy("n").collect()] == [0, 1]


def test_translations(spark, tmp_path):
    editions = [{"languageId": "fr", "displayName": "French", "editionId": k, "file": "fr.json"} for k in ("a", "b")] + [{"languageId": "en", "displayName": "English", "editionId": "c", "file": "en.json"}]
    (tmp_path / "index.json").write_text(json.dumps({"verseCount": "3", "editions": editions}))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "fr.json").write_text(json.dumps({"verses": {"1:1": "un", "1:2": "deux", "bad": "x"}}))
    (tmp_path / "t" / "en.json").write_text(json.dumps({"verses": {"1:1": "one"}}))
    assert {r["languageId"]: (r["editionId"], r["verses"]) for r in files.translations(spark, str(tmp_path / "index.json")).collect()} == {"fr": ("b", 3), "en": ("c", 3)}
    verses = files.translated_verses(spark, str(tmp_path / "t"))
    assert {tuple(r) for r in verses.collect()} == {("fr", 1, 1, "un"), ("fr", 1, 2, "deux"), ("en", 1, 1, "one")}
    files.store_translations(verses, str(tmp_path / "table"))
    kept = spark.read.parquet(str(tmp_path / "table"))
    assert {tuple(r) for r in files.available_keys(kept, "fr").collect()} == {(1, 1), (1, 2)}
    assert "PartitionFilters: [isnotnull(language" in kept.where("language = 'fr'")._jdf.queryExecution().toString()


def test_corpus_and_manifest(spark, tmp_path):
    chapters = spark.createDataFrame([(1, "one"), (2, "two")], "chapter int, name string")
    verses = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "c")], "chapter int, verse int, text string")
    files.write_corpus(chapters, verses, str(tmp_path / "c"), "v1")
    m = spark.read.json(str(tmp_path / "c" / "manifest")).first()
    assert (m["verseCount"], m["surahCount"], m["corpusVersion"]) == ("3", "2", "v1")
    for f in m["files"]:
        data = next((tmp_path / "c").glob(f"*/{f['file']}")).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f["bytes"], f["sha256"])
    assert spark.read.json(str(tmp_path / "c" / "verses")).count() == 3


def test_clips(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a.wav", "surah": 1, "ayahStart": 1, "ayahEnd": 2}, {"file": "b.wav"}, {"file": "c.wav", "surah": 2, "ayahStart": 1, "ayahEnd": 1, "includesBismillah": False}]))
    (tmp_path / "d").mkdir()
    for name, text in (("corpus_003_001_004.wav", "x"), ("told.wav", "x"), ("told.txt", "some words"), ("odd.wav", "x"), ("blank.WAV", "x"), ("blank.txt", " ")):
        (tmp_path / "d" / name).write_text(text)
    out = {r["item"].split("/")[-1]: r for r in files.clips(spark, str(tmp_path / "m.json"), str(tmp_path / "d")).collect()}
    assert set(out) == {"a.wav", "c.wav", "corpus_003_001_004.wav", "told.wav"}
    assert out["a.wav"]["opening"] and not out["c.wav"]["opening"] and out["corpus_003_001_004.wav"]["last"] == 4
    assert out["told.wav"]["reference"].endswith("told.txt") and out["told.wav"]["chapter"] is None
