"""Windowed transcription against one pass, and replayed clips against the clips."""

import random
import wave

import numpy as np
import pytest

from spanloom.sources import replay
from spanloom.streaming import transcribe as W

PIECES = {i: f"▁w{i}" if i % 3 else f"x{i}" for i in range(1, 40)} | {40: "<unk>"}


def frames(seed, seconds):
    """Tokens of 0.04 s frames: words of one to three pieces, some held long, blanks between, and a few pauses."""
    rng, out = random.Random(seed), []
    while len(out) < seconds / 0.04:
        out += [0] * rng.randint(1, 4)
        for k in [rng.choice([i for i in range(1, 40) if i % 3]), *(rng.choice(range(3, 40, 3)) for _ in range(rng.randint(0, 2)))]:
            out += [k] * rng.randint(1, 12) + [0] * rng.randint(1, 2)
    return out[: int(seconds / 0.04)]


@pytest.mark.parametrize(("seed", "seconds"), [(1, 20), (2, 95), (3, 300), (4, 30), (5, 52.04)])
def test_windows_give_what_one_pass_gives(spark, seed, seconds):
    tokens, rng = frames(seed, seconds), random.Random(seed)
    following = [next((x for x in tokens[n:] if x), 1) for n in range(len(tokens))]
    pause = [t == 0 and f % 3 > 0 and rng.random() < 0.006 for t, f in zip(tokens, following, strict=True)]  # between words
    one = W.timed_words(tokens, 0.0, len(tokens) * 0.04, PIECES, 0)
    rows = spark.createDataFrame([(7, n, 0.04, t, p) for n, (t, p) in enumerate(zip(tokens, pause, strict=True))], "session long, n long, seconds double, token int, pause boolean")
    out = W.transcribed(rows, PIECES, 0, W.WindowConfig(lookahead=5.0)).collect()
    assert [r["word"] for r in sorted(out, key=lambda r: r["start"])] == [w for w, _, _ in one]
    assert np.allclose([r["start"] for r in sorted(out, key=lambda r: r["start"])], [a for _, a, _ in one], atol=1e-3)


def test_windows_are_bounded_and_cut_at_pauses():
    c, s = W.WindowConfig(longest=3, overlap=1), W.Windows()
    out = [x for k in range(100) for x in W.window_step(s, {"seconds": 0.1, "token": k, "pause": k == 40}, c)]
    assert [x[:2] for x in out[:2]] == [(0.0, 3.0), (2.0, 4.1)] and [x[3] for x in out[:3]] == [False, True, False]
    assert out[0][2] == list(range(30)) and out[1][2] == list(range(20, 41)) and len(s.tokens) <= 30
    assert W.window_flush(s)[0][3] and W.window_flush(W.Windows()) == []


def test_stream_of_two_stateful_steps_is_the_batch(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = []
        for k in (1, 2):
            tokens = frames(k, 70 + 10 * k)
            rows += [(k, n, 0.04, t, False, n == len(tokens) - 1) for n, t in enumerate(tokens)]
        df = spark.createDataFrame(rows, "session long, n long, seconds double, token int, pause boolean, ended boolean")
        batch = sorted(map(str, W.transcribed(df, PIECES, 0).collect()))
        for part in ("n < 1000", "n >= 1000"):
            df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = W.transcribed_stream(source, PIECES, 0, "ended").writeStream.format("memory").queryName("transcribed").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
            assert sorted(map(str, spark.table("transcribed").collect())) == batch and batch
        finally:
            query.stop()
    finally:
        spark.conf.unset(name)


def test_replay_keeps_the_longest_decoding_of_a_segment():
    s = W.Replay()
    say = lambda ref, text, stable=True, seconds=5.0, advanced=0.0: W.replay_step(s, {"ref": ref, "text": text, "stable": stable, "seconds": seconds, "advanced": advanced})
    say("1:1", "one", False)
    say("1:1", "one two")
    say("1:1", "one two three", advanced=2.0)
    say("1:1-2", "two three four five")
    say("1:1-2", "two three four", seconds=14.99)
    say("", "noise", False)
    say("1:2", "six seven")
    assert W.replay_flush(s) == [("1:1,1:1-2,1:2", "1:1,1:1-2,1:2", "1:1,1:2", "one two three four five six seven", 7)]
    assert W.replay_flush(W.Replay()) == []


def test_clips_are_replayed_once_over_a_restart(spark, tmp_path):
    rng, folder = np.random.default_rng(1), tmp_path / "clips"
    folder.mkdir()
    for k, samples in enumerate((16_000, 9_001)):
        with wave.open(str(folder / f"corpus_00{k}.wav"), "wb") as w:
            w.setnchannels(1 + k)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes((rng.standard_normal(samples * (1 + k)) * 3000).astype("<i2").tobytes())
    spark.dataSource.register(replay.ClipReplay)

    def play(stop_after):
        stream = spark.readStream.format("clips").option("chunksPerBatch", 7).load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        import time

        end = time.time() + 90
        while time.time() < end and query.isActive and spark_rows(spark, tmp_path) < stop_after:
            time.sleep(0.5)
        query.stop()

    play(20)
    play(50 + 29)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(r for p in replay.clips(str(folder)) for r in replay.chunks(p, 0, 10**6, 20))
    assert got == want and len(want) == 50 + 29 and [r[1] for r in want if r[5]] == [49, 28]


def spark_rows(spark, tmp_path):
    return spark.read.schema(replay.SCHEMA).parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() else 0
