"""Clips transcribed and compared many at once: the same as one by one."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest

from spanloom.operators import choices
from spanloom.operators import kernels as K
from spanloom.streaming import transcribe as W


def some_pairs():
    rng = random.Random(3)
    known = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(30)] + ["ﷺ", "ﻻ", "x" * 70]
    said = lambda: [rng.choice(known) for _ in range(rng.randint(0, 14))]
    pairs = [(said(), said()) for _ in range(300)]
    return pairs + [(a, a) for a, _ in pairs[:20]]


def plain_alignment(a, b, gap=0.5):
    score = [[-gap * (i + j) if not i or not j else 0.0 for j in range(len(a) + 1)] for i in range(len(b) + 1)]
    alike = [[K.ratio(x, y) for x in a] for y in b]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            score[i][j] = max(score[i - 1][j - 1] + alike[i - 1][j - 1], score[i][j - 1] - gap, score[i - 1][j] - gap)
    i, j, rows = len(b), len(a), []
    while i or j:
        if i and j and score[i - 1][j - 1] + alike[i - 1][j - 1] >= score[i][j] - 1e-9:
            i, j = i - 1, j - 1
            s = alike[i][j]
            rows.append(("match" if s >= 0.8 else "near" if s >= 0.5 else "mismatch", j, i))
        elif j and (not i or score[i][j - 1] - gap >= score[i][j] - 1e-9):
            j -= 1
            rows.append(("missing", j, None))
        else:
            i -= 1
            rows.append(("extra", None, i))
    return rows[::-1]


@pytest.mark.parametrize(("cells", "held"), [(1 << 20, 1 << 20), (50, 300)])
def test_pairs_together(monkeypatch, cells, held):
    monkeypatch.setattr(K, "CELLS", cells)
    monkeypatch.setattr(K, "TOGETHER", held)
    pairs = some_pairs()
    references, hypotheses = map(list, zip(*pairs, strict=True))
    assert K.word_errors_all(references, hypotheses) == [K.word_errors(a, b) for a, b in pairs]
    found = K.align_pairs(references, hypotheses)
    assert [[r[:3] for r in rows] for rows in found] == [plain_alignment(a, b) for a, b in pairs]
    assert K.align_pairs([], []) == [] and K.word_errors_all([], []) == []


def test_windows_of_many_frames_at_once():
    rng, c = random.Random(4), W.WindowConfig(longest=3.0, overlap=0.8, least=0.5)
    frames = [{"seconds": rng.choice([0.08, 0.1, 0.0]), "token": k, "pause": rng.random() < 0.03} for k in range(900)]
    one, many, want, got, at = W.Windows(), W.Windows(), [], [], 0
    for f in frames:
        want += W.window_step(one, f, c)
    while at < len(frames):
        part = frames[at : at + rng.choice([0, 1, 7, 200])]
        got += W.windows_in(many, {n: np.array([f[n] for f in part]) for n in ("seconds", "token", "pause")} if part else {n: np.empty(0) for n in ("seconds", "token", "pause")}, c)
        at += len(part)
    assert got == want and len(want) > 20 and many == one


def test_clips_are_compared_in_one_pass(spark):
    words = spark.createDataFrame([(1, "one", 0.0), (1, "two", 1.0)], "clip long, word string, start double")
    references = spark.createDataFrame([(1, "one two"), (2, "three")], "clip long, text string")
    df = choices.accuracy(words, references)
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    assert out.getvalue().count("MapInPandas") == 1
    assert {r["clip"]: (r["f1"], r["rate"], r["reference_words"], r["hypothesis_words"], r["passed"]) for r in df.collect()} == {1: (1.0, 0.0, 2, 2, True), 2: (0.0, 1.0, 1, 0, False)}
