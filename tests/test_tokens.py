from spanloom.operators import tokens


def test_token_table(spark):
    pieces = ["<unk>", "\u2581al", "\u2581alpha", "ph", "a", "\u2581be", "ta", "\u2581", "b", "e", "t", "\u2581ga"]
    vocabulary = spark.createDataFrame(list(enumerate(pieces)), "token_id int, token_text string")
    verses = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, " beta"), (1, 4, "alpha gaz"), (2, 1, None)], "chapter int, verse int, text string")
    found = tokens.encoded(verses, vocabulary)
    assert {(r["chapter"], r["verse"]): (r["tokens"], r["unknown"]) for r in found.collect()} == {(1, 1): ([2, 5, 6], 0), (1, 2): ([5, 6], 0), (1, 4): ([2, 11, 0], 1), (2, 1): ([], 0)}
    table = {(r["chapter"], r["first"], r["last"]): r["tokens"] for r in tokens.token_table(found, 3).collect()}
    assert table == {(1, 1, 1): [2, 5, 6], (1, 1, 2): [2, 5, 6, 5, 6], (1, 2, 2): [5, 6], (1, 4, 4): [2, 11, 0], (2, 1, 1): []}
    assert {(r["chapter"], r["verse"]) for r in tokens.uneven(found, verses, vocabulary).collect()} == {(1, 4)}
