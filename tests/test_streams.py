"""Folds: expected values, and batch against stream."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.streaming import folds, live
from spanloom.streaming import segments as S
from spanloom.streaming import windows as W


def test_segmenter_closes_on_silence_and_at_its_greatest_length():
    c, s = S.SegmenterConfig(), S.Segmenter()
    loud, still = {"seconds": 0.5, "rms": 0.2, "peak": 0.5}, {"seconds": 0.5, "rms": 0.001, "peak": 0.001}
    out = [x for chunk in [loud] * 3 + [still] * 3 for x in S.segment_step(s, chunk, c)]
    assert out == [(0.0, 3.0, "silence", True)]
    out = [x for chunk in [loud] * 60 for x in S.segment_step(s, chunk, c)]
    assert out == [(3.0, 33.0, "maxDuration", True)] and s.start == 32.0
    assert S.segment_flush(s, c) == [(32.0, 33.0, "stopped", False)]


def test_reconciler_replaces_partial_words_and_keeps_committed_ones():
    s = S.Reconciler()
    first = {"words": [("one", 0.0, 1.0), ("two", 1.0, 2.0), ("thr", 4.5, 5.0)], "window_start": 0.0, "window_end": 5.0, "final": False}
    assert [w[0] for w in S.reconcile_step(s, first)] == ["one", "two"]
    last = {"words": [("two", 1.0, 2.0), ("three", 4.5, 5.6)], "window_start": 1.0, "window_end": 6.0, "final": True}
    assert [w[0] for w in S.reconcile_step(s, last)] == ["three"]
    silent = {"words": [], "window_start": 6.0, "window_end": 11.0, "final": True}
    assert S.reconcile_step(s, silent) == []


def test_tracker():
    s = S.Tracker()
    see = lambda ref, score=0.8, margin=0.0, nxt=False: S.tracker_step(s, {"ref": ref, "score": score, "margin": margin, "next": nxt})
    assert see("1:1")[0][0] == "verse_candidate"
    assert see("1:1")[0][0] == "verse_match"
    assert see("1:2", 0.5, 0.07, True)[0][0] == "verse_match"
    assert see("9:9", 0.9, 0.5)[0][0] == "verse_candidate"
    assert [e for _ in range(4) for e in see("")] == [("rollback", "1:2", 0.0)]


def chunks(spark):
    rows = [(k, n, f"{'abcdefgh'[n : n + 3]} {k}"[: 5 if n % 2 else 4].replace("", " ").strip()) for k in range(3) for n in range(6)]
    return spark.createDataFrame(rows, "session long, n long, text string")


@pytest.fixture(scope="module")
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def level_rows(spark):
    rows = [(k, n, 0.5, [0.2, 0.001][(n // (4 + k)) % 2], 0.5) for k in range(3) for n in range(40)]
    return spark.createDataFrame(rows, "session long, n long, seconds double, rms double, peak double")


def timed_rows(spark):
    rows = [(k, n, float(4 * n), 4.0 * n + 5, n == 5, [[f"w{k}{n}{i}", 4.0 * n + i, 4.0 * n + i + 0.8] for i in range(5)]) for k in range(2) for n in range(6)]
    return spark.createDataFrame([(k, n, a, b, f, json.dumps(w)) for k, n, a, b, f, w in rows], "session long, n long, window_start double, window_end double, final boolean, words string")


def tracked_rows(spark):
    rows = [(k, n, "" if n % 7 > 3 else f"1:{n // 7 + k}", 0.8, 0.2, n % 7 == 0) for k in range(2) for n in range(30)]
    return spark.createDataFrame(rows, "session long, n long, ref string, score double, margin double, next boolean")


C = S.SegmenterConfig()
FOLDS = {
    "stitcher": (chunks, S.Stitcher, S.stitch_step, S.STITCHED, None),
    "segmenter": (level_rows, S.Segmenter, lambda s, x: S.segment_step(s, x, C), S.SEGMENT, lambda s: S.segment_flush(s, C)),
    "reconciler": (timed_rows, S.Reconciler, lambda s, x: S.reconcile_step(s, x | {"words": json.loads(x["words"])}), S.TIMED, None),
    "tracker": (tracked_rows, S.Tracker, S.tracker_step, S.TRACKED, None),
}


@pytest.mark.parametrize("name", FOLDS)
def test_batch_equals_stream(stateful, tmp_path, name):
    """In two micro-batches; each session's last row closes it, and what is left is flushed."""
    made, state, step, out, flush = FOLDS[name]
    rows = made(stateful)
    last = F.max("n").over(Window.partitionBy("session"))
    rows = rows.withColumn("ended", F.col("n") == last)
    batch = folds.run_batch(rows, "session", "n", state, step, out, flush)
    half = rows.agg(F.max("n")).first()[0] // 2
    rows.where(F.col("n") <= half).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = folds.run_stream(stream, "session", "n", state, step, out, flush, "ended")
    query = found.writeStream.format("memory").queryName(f"of_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        rows.where(F.col("n") > half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        got, want = sorted(map(str, stateful.table(f"of_{name}").collect())), sorted(map(str, batch.collect()))
        assert got == want and want
    finally:
        query.stop()


def said(ref, rms=0.2, read=8, p90=0.2):
    return {"seconds": 0.5, "rms": rms, "frames": 100, "median": 0.01, "p90": p90, "ref": ref, "read": read, "words": 10, "end_frame": 39, "all_frames": 50, "follows": True}


def test_live_windows_commit_and_go_on():
    c, s = live.LiveConfig(), live.Live()
    say = lambda *a, **k: live.live_step(s, said(*a, **k), c)
    out = [x for _ in range(12) for x in say("1:1")]
    assert [x[2] for x in out[:2]] == [False, True] and [x[3] for x in out].count(True) == 1
    first = next(x for x in out if x[3])
    assert first[5] == pytest.approx(min(0.8 * first[4] - 1.0, 0.6 * first[4])) and s.committed == "1:1"
    assert not any(x[3] for _ in range(6) for x in say("1:2", read=2))
    assert any(x[3] for _ in range(6) for x in say("1:2"))
    end = [x for _ in range(3) for x in say("1:2", rms=0.001)]
    assert end[-1][0] and s.start == s.now and s.run == ["", 0]


def test_the_cut_after_a_commit_is_a_point_within_the_window():
    c = live.LiveConfig()
    cut = lambda end_frame, frames=50: live.cut_point(0.0, 5.0, 20.0, end_frame, frames, c)
    assert cut(-1) == 0 and cut(10, 0) == 0 and cut(2) == 0  # nothing read beyond the overlap
    assert cut(49) == pytest.approx(14.0) and cut(9) == pytest.approx(5 + 0.2 * 15 - 1)


def test_a_session_that_ends_without_silence_keeps_its_last_window():
    c, s = live.LiveConfig(), live.Live()
    for _ in range(2):
        assert live.live_step(s, said("2:1"), c) == []
    assert live.live_flush(s, c) == [(True, "2:1", False, False, 1.0, 0.0)] and live.live_flush(s, c) == []
    assert live.live_flush(live.Live(), c) == []
    s = live.Live()
    live.live_step(s, said("2:1", p90=0.011), c)
    assert live.live_flush(s, c) == []  # no speech in it


def test_final_sequence():
    s = live.Hypotheses()
    for k in range(100):
        live.hypothesis_step(s, {"candidates": [(f"1:{k}", 0.9), ("9:9", 0.1)], "commit": ("1:5", 0.5) if k == 5 else None})
    assert len(s.cycles) == live.CYCLES
    refs, confidence = live.hypothesis_flush(s)[0]
    assert refs.split(",") == [f"1:{k}" for k in range(20, 100)] and confidence == 0.9
    assert live.hypothesis_flush(live.Hypotheses(committed=[["2:3-4", 0.55]])) == [("2:3,2:4", 0.55)]
    assert live.hypothesis_flush(live.Hypotheses()) == []


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) AS ts, id % 2 AS event_type, CAST(id AS double) AS value FROM range(48)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = W.windowed(W.timed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 day"), "1 day")
    query = stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert sorted(spark.table("days").collect()) == sorted(W.windowed(W.timed(rows), "1 day").collect())
    finally:
        query.stop()
    assert W.sessions(W.timed(rows), "30 minutes", "event_type").count() == 48


def test_a_stream_of_no_rows(spark):
    assert folds.run_batch(chunks(spark).where("false"), "session", "n", S.Stitcher, S.stitch_step, S.STITCHED).count() == 0


@pytest.mark.parametrize("text", [None, ""])
def test_empty_texts(text):
    s = S.Stitcher()
    assert S.stitch_step(s, {"text": text}) == [] and s.count == 0


def test_previews_keep_their_distance():
    c, s = S.SegmenterConfig(), S.Previews()
    loud, still = {"seconds": 0.5, "rms": 0.2, "peak": 0.5}, {"seconds": 0.5, "rms": 0.001, "peak": 0.001}
    out = [x for k in range(30) for x in S.preview_step(s, loud, c)]
    assert out[:2] == [(0.0, 1.0), (0.0, 2.0)] and out[-1] == (3.0, 15.0) and len(out) == 15
    out = [x for k in range(3) for x in S.preview_step(s, still, c)]
    assert s.boundary == 16.5 and len(out) == 1
    assert [S.preview_step(s, loud, c) for _ in range(2)] == [[], [(16.5, 17.5)]]
    assert S.Previews(**json.loads(json.dumps({"segmenter": {"start": 1.0}, "last": 2.0}))).segmenter.start == 1.0
