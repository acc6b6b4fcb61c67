"""Outcomes of the matcher for made-up evidence over a small corpus."""

import random

import pytest

from spanloom.operators import matcher

BLANK, OPENING = 200, ["in", "the", "name"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Three chapters of words that are a token each; the first verse of each begins with the opening."""
    rng = random.Random(1)
    names = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(150)]
    vocabulary = list(dict.fromkeys(names))
    token = {w: k for k, w in enumerate(OPENING + vocabulary)}
    verses = {(c, v): (OPENING if v == 1 else []) + rng.sample(vocabulary, rng.choice((4, 6, 9))) for c in (1, 2, 3) for v in range(1, 9)}
    spans = [(c, a, b, [token[w] for v in range(a, b + 1) for w in verses[c, v]]) for c in (1, 2, 3) for a in range(1, 9) for b in range(a, 9)]
    table = spark.createDataFrame([(c, v, " ".join(w)) for (c, v), w in verses.items()], "chapter int, verse int, text string")
    return verses, token, table, spark.createDataFrame(spans, "chapter int, first int, last int, tokens array<int>")


def frames(tokens, trailing=0):
    states = [BLANK] * (1 + trailing)
    for t in tokens:
        states += [t, BLANK]
    return [[-0.01 if k == s else -14.0 for k in range(BLANK + 1)] for s in states]


def test_outcomes(spark, corpus):
    verses, token, table, spans = corpus
    odd = [f"zzx{k}qq" for k in range(8)]
    two = verses[2, 3] + verses[2, 4]
    cases = {
        "whole": verses[1, 5],
        "two": two,
        "four": [w for v in range(4, 8) for w in verses[3, v]],
        "cut": verses[1, 6][:-2] if len(verses[1, 6]) > 4 else verses[1, 6][:-1],
        "mixed": verses[2, 3] + verses[2, 4][:-2],
        "extra": verses[1, 5] + odd[: len(verses[1, 5]) + 1],
        "unopened": verses[1, 1][3:],
        "opening": OPENING,
        "off": odd,
        "empty": [],
    }
    rows = [(k, " ".join(w), frames([token.get(x, 190) for x in w], 20 if k in ("cut", "mixed") else 0)) for k, w in cases.items()] + [("null", None, frames([])), ("silent", "some words", [])]
    out = {r["utt_id"]: r for r in matcher.match(spark.createDataFrame(rows, "utt_id string, text string, scores array<array<float>>"), table, spans, BLANK, OPENING, [0, 1, 2]).collect()}
    refs = lambda k: [(m["chapter"], m["verse"]) for m in out[k]["matches"]]
    assert len(out) == len(rows)
    assert (out["whole"]["status"], out["whole"]["scope"], refs("whole")) == ("confirmed", "completeVerses", [(1, 5)]) and out["whole"]["f1"] > 0.9
    assert (out["two"]["status"], refs("two")) == ("confirmed", [(2, 3), (2, 4)])
    assert refs("four") == [(3, v) for v in range(4, 8)] and out["four"]["coverage"] > 0.8 and out["four"]["precision"] > 0.8
    assert (out["cut"]["status"], out["cut"]["scope"]) == ("partial", "partialVerse") and out["cut"]["matches"][0]["word_start"] == 0
    assert out["mixed"]["scope"] in ("mixed", "completeVerses") and refs("mixed")[0] == (2, 3)
    assert out["extra"]["status"] == "candidate" and out["extra"]["precision"] < 0.6 and out["extra"]["coverage"] >= 0.9 and refs("extra") == [(1, 5)]
    assert refs("unopened") == [(1, 1)]
    for k, reason in (("opening", "opening alone"), ("empty", "no words"), ("null", "no words"), ("silent", "no frames")):
        assert (out[k]["status"], out[k]["reason"], out[k]["matches"], out[k]["precision"]) == ("unmatched", reason, [], None)
    assert out["off"]["status"] == "unmatched" and out["off"]["matches"] == []
    assert out["opening"]["asr_text"] == "in the name"


def test_leading_scores_are_the_best_of_all(spark, monkeypatch):
    """Words that most references share, rare ones, ties, texts and references without words, repeated words; in one pass and in several."""
    import random

    from pyspark.sql import functions as F

    from spanloom.operators import recall

    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(n))
    references = spark.createDataFrame([(k, line(rng.randint(0, 9))) for k in range(60)] + [(99, ""), (98, None)], "ref_id long, text string")
    texts = spark.createDataFrame([(f"t{k}", line(rng.randint(0, 12))) for k in range(50)] + [("none", ""), ("null", None), ("common", "the of and")], "text_id string, text string")
    for rule in ({}, {"balance": 0.2, "fit": 0.5}):
        rank = lambda df: sorted(map(tuple, recall.best(df.withColumn("score", F.round("score", 9)), 4).collect()))
        expected = rank(recall.recall_scores(texts, references, **rule))
        for sent in (32_000_000, 500):
            monkeypatch.setattr(recall, "SENT", sent)
            assert rank(recall.leading_scores(texts, references, 4, **rule)) == expected
    assert recall.leading_scores(texts, references.where("false"), 3).count() == 0 and recall.leading_scores(texts.where("false"), references, 3).count() == 0


def test_spans_begin_at_recalled_verses_only(spark, corpus):
    """Tokens are asked for these and the next ones, not for spans of the whole corpus; what shares words with few verses gets the first of all."""
    verses, token, table, spans = corpus
    fragments = spark.createDataFrame([("a", " ".join(verses[2, 4]), frames([token[w] for w in verses[2, 4]])), ("b", "zzx", frames([190]))], "utt_id string, text string, scores array<array<float>>")
    c = matcher.MatchConfig(recalled=2, longest=2)
    asked = []

    def tokens(some):
        asked.extend((r["chapter"], r["verse"]) for r in some.collect())
        return spans.join(some.select("chapter", some["verse"].alias("first")), ["chapter", "first"], "left_semi")

    out = {r["utt_id"]: r["ref"] for r in matcher.match(fragments, table, tokens, BLANK, OPENING, [0, 1, 2], c).collect()}
    found = {(r["utt_id"], r["chapter"], r["verse"], r["text_score"]) for r in matcher.recalled(fragments, table, c).collect()}
    assert {x[1:] for x in found if x[0] == "b"} == {(1, 1, 0.0), (1, 2, 0.0)} and len(found) == 4
    assert set(asked) == {(k[1], v) for k in found for v in (k[2], k[2] + 1)} & set(verses) and len(asked) == len(set(asked))
    assert out["a"] == "2:4"
