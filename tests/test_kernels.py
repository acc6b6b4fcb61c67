"""Dynamic programmes against expected values and plain versions."""

import itertools
import math
import random

import numpy as np
import pytest

from spanloom.operators import kernels as K


def evidence(tokens, blank, size, high=-0.01, low=-12.0):
    states = [blank]
    for t in tokens:
        states += [t, blank]
    out = np.full((len(states), size), low)
    out[np.arange(len(states)), states] = high
    return out


def plain_ctc(logs, tokens, blank):
    total = -math.inf
    for path in itertools.product(range(logs.shape[1]), repeat=len(logs)):
        merged = [k for k, _ in itertools.groupby(path) if k != blank]
        if merged == tokens:
            total = np.logaddexp(total, sum(logs[t, s] for t, s in enumerate(path)))
    return -total / len(logs)


@pytest.mark.parametrize("tokens", [[0], [0, 1], [1, 1]])
def test_ctc_score_adds_up_all_paths(tokens):
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(3), 6))
    assert K.ctc_score(logs, tokens, 2) == pytest.approx(plain_ctc(logs, tokens, 2))
    assert K.ctc_score(logs, tokens, 2, per_token=True) == pytest.approx(plain_ctc(logs, tokens, 2) * 6 / len(tokens))


def test_ctc_feasibility_and_preference():
    logs = evidence([1, 2, 3], 5, 6)
    assert K.ctc_score(logs, [1, 2, 3], 5) < K.ctc_score(logs, [1, 2], 5) < K.INFEASIBLE
    assert K.ctc_score(logs, [1, 2, 3, 4], 5) == K.ctc_score(logs, [], 5) == K.INFEASIBLE
    assert K.tolerant_scores(logs, [[4, 1, 2, 3], [1, 2]], 5, [4]).tolist() == pytest.approx([K.ctc_score(logs, [1, 2, 3], 5), K.ctc_score(logs, [1, 2], 5)])


def test_many_sequences_score_as_one_by_one():
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(7), 23))
    every = [rng.integers(0, 6, rng.integers(0, 14)).tolist() for _ in range(60)] + [[2, 2, 2], []]
    for per_token in (False, True):
        assert K.ctc_scores(logs, every, 6, per_token) == pytest.approx(np.array([K.ctc_score(logs, s, 6, per_token) for s in every]))


def plain_alignment(ref, hyp, gap=0.5):
    score = [[-gap * (i + j) if not i or not j else 0.0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            score[i][j] = max(score[i - 1][j - 1] + K.ratio(ref[i - 1], hyp[j - 1]), score[i - 1][j] - gap, score[i][j - 1] - gap)
    i, j, rows = len(ref), len(hyp), []
    while i or j:
        if i and j and abs(score[i][j] - score[i - 1][j - 1] - K.ratio(ref[i - 1], hyp[j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            rows.append((i, j))
        elif i and (not j or abs(score[i][j] - score[i - 1][j] + gap) < 1e-9):
            i -= 1
            rows.append((i, None))
        else:
            j -= 1
            rows.append((None, j))
    return rows[::-1]


def test_many_alignments_equal_cell_by_cell():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    assert K.ratios(words, words[:7]) == pytest.approx(np.array([[K.ratio(a, b) for b in words[:7]] for a in words]))
    for _ in range(15):
        hyp = [rng.choice(words) for _ in range(rng.randint(0, 9))]
        refs = [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(6)]
        assert [[(i, j) for _, i, j, _ in rows] for rows in K.align_all(refs, hyp)] == [plain_alignment(r, hyp) for r in refs]


def test_ctc_align():
    assert K.ctc_align(evidence([1, 2, 3], 5, 6), [1, 2, 3], 5) == [(1, 1), (3, 3), (5, 5)]
    assert K.ctc_align(evidence([1], 5, 6), [1, 2], 5) is None
    assert K.words_read(evidence([1, 2], 5, 6), [[1], [2], [3]], 5) == 2


def test_alignment_expected():
    rows = K.align(["bismi", "allah", "alrahman", "alrahim"], ["bismi", "alrahman", "alrahim"])
    assert [r[0] for r in rows] == ["match", "missing", "match", "match"]
    assert [r[0] for r in K.align(["a1", "b2"], ["a1", "b2", "c3"])] == ["match", "match", "extra"]
    assert K.align([], []) == []


@pytest.mark.parametrize(("ref", "hyp", "want"), [(["a", "b", "c"], ["a", "x", "c", "d"], (3, 1, 0, 1)), ([], [], (0, 0, 0, 0)), ([], ["a"], (0, 0, 0, 1)), (["a"], [], (1, 0, 1, 0))])
def test_word_errors(ref, hyp, want):
    assert K.word_errors(ref, hyp) == want


def test_word_error_rates(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, [], ["a"]), (3, [], []), (4, None, None)], "pair_id long, reference array<string>, hypothesis array<string>")
    assert {r["pair_id"]: r["rate"] for r in K.word_error_rates(rows).collect()} == {1: pytest.approx(2 / 3), 2: math.inf, 3: 0.0, 4: 0.0}
    out = {r["pair_id"]: r for r in K.alignments(rows).collect()}
    assert out[3]["f1"] == 0.0 and out[1]["match"] == 2


def test_edit_distance_long_and_short_agree():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(2))
        rows = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, rows[0] = rows[0], i
            for j, d in enumerate(b, 1):
                last, rows[j] = rows[j], min(last + (c != d), rows[j] + 1, rows[j - 1] + 1)
        assert K.edit_distance(a, b) == rows[-1]


def test_tokenizers():
    known = {"ab", "abc", "c", "cd", "d", "a", "b"}
    assert K.fewest_tokens("abcd", known) == ["abc", "d"]  # two tokens either way; the larger squares
    assert K.longest_tokens("abxd", known) == ["ab", "<unk>", "d"]
    assert K.fewest_tokens("xyz", known) is None and K.fewest_tokens("", known) == []


def test_other_kernels():
    assert K.stitch(["a b c d", "c d e", "d e", "z"]) == ["a", "b", "c", "d", "e", "z"]
    assert K.longest_stable_prefix([0.3, 0.35, 0.9], [1, 2, 3]) == 1
    assert K.nearest_fragment("bcd", "abcde") == 1.0 and K.shared_subsequence("ace", "abcde") == pytest.approx(0.6)
    assert K.follow_words(["one", "three"], ["one", "two", "three"]) == (3, [0, 2])
    assert K.fnv64("") == "cbf29ce484222325" and K.fnv64("a") == "af63dc4c8601ec8c"
    assert K.best_path([[("1:1", 0.5), ("2:1", 0.6)], [("1:2", 0.5)]], K.transition) == ["1:1", "1:2"]


def test_best_path_keeps_the_last_cycles(spark, monkeypatch):
    from spanloom.plans import sequences

    turns = spark.createDataFrame([(1, n, f"turn {n}") for n in range(100)], "conv_id long, turn long, text string")
    monkeypatch.setattr(sequences, "read", lambda *_: turns)
    path = sequences.best_path(spark, "").collect()[0]["path"].split(",")
    assert len(path) == 80 and 20 <= int(path[0].split(":")[1]) <= 24 and int(path[-1].split(":")[1]) >= 99


def test_progress_by_frames_and_letters():
    logs = evidence([1, 2, 3, 4], 5, 6)
    assert K.progress(logs, [[1], [2, 3], [4]], 5) == (3, 7)
    assert K.progress(evidence([1, 2], 5, 6), [[1], [2]], 5) == (2, 3)
    assert K.progress(logs, [], 5) == (0, -1) and K.progress(evidence([], 5, 6), [[1]], 5)[1] == -1
    more = np.concatenate([evidence([1, 2], 5, 6), evidence([], 5, 6), evidence([], 5, 6), evidence([], 5, 6), evidence([], 5, 6)])
    assert K.progress(more, [[1], [2], [3]], 5)[0] in (2, 3)
    words = "alpha beta gamma delta epsilon".split()
    assert K.heard_up_to("alpha beta", words) == 1 and K.heard_up_to("beta gamma", words) == 2 and K.heard_up_to("delta", words) == 3
    assert K.heard_up_to("zz", words) == -1 and K.heard_up_to("zzzzzzz", words) == -1 and K.heard_up_to(" ".join(words), words) == -1


def test_word_ratios_of_any_length_and_alignments_in_any_company():
    import random

    import numpy as np

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcé") for _ in range(n))
    a, b = ([word(r.choice([0, 1, 3, 8, 63, 64, 65, 90])) for _ in range(30)] for _ in range(2))
    expected = [[1.0 if not x and not y else 1 - K.edit_distance(x, y) / max(len(x), len(y)) for y in b] for x in a]
    assert np.array_equal(K.ratios(a, b), np.array(expected))
    references = [[word(r.randint(1, 4)) for _ in range(r.randint(0, 40))] for _ in range(60)]
    hypothesis = [word(r.randint(1, 4)) for _ in range(30)]
    assert K.align_all(references, hypothesis) == [K.align_all([x], hypothesis)[0] for x in references]


def test_pairs_of_one_hypothesis_are_aligned_together(spark, monkeypatch):
    """A call for each would compare the same words again."""
    import pandas as pd

    class Pairs:
        schema = {"pair_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "long"})()})()}
        select = lambda self, *c: self

        def mapInPandas(self, run, kind):  # noqa: N802
            self.calls, real = [], K.align_all
            monkeypatch.setattr(K, "align_all", lambda refs, hyp: self.calls.append(len(refs)) or real(refs, hyp))
            self.found = list(run(iter([pd.DataFrame({"pair_id": [1, 2, 3], "reference": [["a", "b"], ["b"], None], "hypothesis": [["b"], ["b"], ["b"]]})])))[0]
            raise StopIteration

    pairs = Pairs()
    with pytest.raises(StopIteration):
        K.alignments(pairs)
    assert pairs.calls == [3]
    assert pairs.found.to_numpy().tolist() == [[1, 1, 0, 0, 1, 0], [2, 1, 0, 0, 0, 0], [3, 0, 0, 0, 0, 1]]
