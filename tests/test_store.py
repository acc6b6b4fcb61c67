"""Record store and decoding: expected rows."""

from pyspark.sql import functions as F

from spanloom.operators import decode, recall, store


def test_save_is_idempotent_and_numbers_follow(spark):
    drafts = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], "k string, at int, v string")
    empty = drafts.where("false").withColumn("display_sequence", F.lit(0).cast("long"))
    first = store.save(empty, drafts, ["k"])
    assert sorted((r["k"], r["v"], r["display_sequence"]) for r in first.collect()) == [("a", "z", 1), ("b", "y", 2)]
    more = spark.createDataFrame([("c", 3, "new"), ("a", 3, "again")], "k string, at int, v string")
    second = store.save(first, more, ["k"])
    assert sorted((r["k"], r["v"], r["display_sequence"]) for r in second.collect()) == [("a", "again", 1), ("b", "y", 2), ("c", "new", 3)]
    assert sorted(second.collect()) == sorted(store.save(second, more, ["k"]).select(second.columns).collect())


def test_late_results_and_cascade(spark):
    current = spark.createDataFrame([("a", 2, "en")], "id string, revision int, language string")
    late = spark.createDataFrame([("a", 1, "en", "old"), ("a", 2, "en", "now"), ("b", 2, "en", "gone")], "id string, revision int, language string, text string")
    assert [r["text"] for r in store.guarded(late, current, ["id", "revision", "language"]).collect()] == ["now"]
    assert [r["text"] for r in store.without(late, current, ["id"]).collect()] == ["gone"]


def test_recovery_and_pick(spark):
    jobs = spark.createDataFrame([(1, "running"), (2, "done"), (3, "failed")], "id int, state string")
    assert sorted(r["state"] for r in store.recovered(jobs).collect()) == ["done", "failed", "pending"]
    rows = spark.createDataFrame([("a", 1, "done"), ("a", 2, "failed"), ("b", 1, "failed"), ("b", 2, "pending")], "k string, at int, state string")
    assert sorted((r["k"], r["at"]) for r in store.picked(rows, ["k"], "at").collect()) == [("a", 1), ("b", 2)]


def test_hydrated_children_do_not_multiply(spark):
    records = spark.createDataFrame([(1,), (2,)], "id int")
    matches = spark.createDataFrame([(1, 1, "m1"), (1, 0, "m0")], "id int, ordinal int, ref string")
    metrics = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7)], "id int, revision int, f1 double")
    out = {r["id"]: r for r in store.hydrated(records, "id", matches=matches, metrics=metrics).collect()}
    assert [m["ref"] for m in out[1]["matches"]] == ["m0", "m1"] and len(out[1]["metrics"]) == 2 and out[2]["matches"] == []


def test_curated_is_all_or_nothing(spark):
    needs = spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("s", 0, 1), ("s", 1, 9)], "record string, ordinal int, verse int")
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "verse int, text string")
    assert [tuple(r) for r in store.curated(needs, texts, "record", ["verse"]).collect()] == [("r", "one two")]


def test_decoding(spark):
    scores = lambda k: [1.0 if i == k else 0.0 for i in range(6)]
    rows = [("u", t, scores(k)) for t, k in enumerate([5, 1, 1, 5, 1, 2, 5])] + [("v", 0, scores(5))]
    frames = spark.createDataFrame(rows, "utt_id string, t int, scores array<double>")
    tokens = decode.collapsed(frames, 5)
    assert [(r["token"], r["first"], r["last"]) for r in tokens.orderBy("ordinal").collect()] == [(1, 1, 2), (1, 4, 4), (2, 5, 5)]
    assert {r["utt_id"]: r["last"] for r in decode.last_content_frame(frames, 5).collect()} == {"u": 5, "v": -1}
    vocabulary = spark.createDataFrame([(0, "<unk>"), (1, "▁bi"), (2, "sm"), (5, "<blank>")], "token_id int, token_text string")
    assert decode.tokens_to_text(tokens, vocabulary).first()["text"] == "bi bism"
    assert decode.blank_id(vocabulary).first()["blank_id"] == 5 and decode.blank_id(vocabulary.where("false")).first()["blank_id"] == 0


def test_arbitration(spark):
    rows = [("t", 1, 0.9, 0.9, 0.9, 5, 1.0), ("t", 2, 0.9, 1.0, 0.9, 5, 2.0), ("u", 1, 0.4, 0.5, 0.5, 3, 1.0), ("w", 1, 0.1, 0.1, 0.1, 0, 1.0)]
    c = spark.createDataFrame(rows, "text_id string, ref_id int, precision double, coverage double, text_score double, agreeing int, sort double")
    out = {r["text_id"]: r for r in recall.arbitrated(c).collect()}
    assert (out["t"]["ref_id"], out["t"]["status"]) == (1, "partial")
    assert (out["u"]["ref_id"], out["u"]["status"]) == (1, "candidate")
    assert (out["w"]["ref_id"], out["w"]["status"], out["w"]["confidence"]) == (None, "unmatched", None)


def test_tuning_rates(spark):
    from spanloom.operators import choices

    rows = [("a", 1, 5, 5, 1, 1.0, 10, 10), ("a", 2, None, None, None, None, None, 9), ("a", 3, 4, 6, 3, 0.5, 17, 10), ("a", 4, 6, 7, 2, None, 16, 10), ("b", 1, None, None, None, None, None, 3)]
    out = {r["setting"]: tuple(r)[1:] for r in choices.tuning(spark.createDataFrame(rows, "setting string, n int, first int, last int, verses int, coverage double, reference_words int, words int")).collect()}
    assert out["a"] == (4, 0.75, 0.5, 1 / 3, 0.5, 2.0, 2.0, "1:1,2:1,3:1") and out["b"] == (1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "")


def test_accuracy_gate(spark):
    from spanloom.operators import choices

    words = spark.createDataFrame([(1, w, float(i)) for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())] + [(2, "alpha", 0.0)], "clip long, word string, start double")
    references = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "quite other words"), (3, "nothing heard"), (4, "")], "clip long, text string")
    out = {r["clip"]: r for r in choices.accuracy(words, references).collect()}
    assert out[1]["passed"] and out[1]["rate"] == 0.0 and not out[2]["passed"] and out[3]["rate"] == 1.0 and out[3]["hypothesis_words"] == 0 and len(out) == 4
    assert tuple(choices.gate(choices.accuracy(words, references)).first()) == (1, 4, False)
    assert tuple(choices.gate(choices.accuracy(words, references.where("clip = 1"))).first()) == (1, 1, True)
    assert tuple(choices.gate(choices.accuracy(words, references.where("false"))).first()) == (0, 0, False)
