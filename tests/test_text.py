"""Text functions: expected values, and rules that hold for any text."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import kernels as K


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "  a   b\t　c ", "﻿بِسْمِ ٱللَّهِ", "ﻻﺎ x", "أإآةىـ", "plain"])
def test_normalize_agrees_with_the_python_helper_and_is_idempotent(spark, text):
    once = one(spark, T.normalize(F.col("t")), t=text)
    assert once == K.normal(text)
    assert one(spark, T.normalize(F.col("t")), t=once) == once


def test_normalize_expected(spark):
    assert one(spark, T.normalize(F.col("t")), t="بِسْمِ ٱللَّهِ") == "بسم الله"
    assert one(spark, T.normalize(F.col("t")), t=None) is None


@pytest.mark.parametrize(("a", "b", "ratio", "sums"), [("", "", 1.0, 1.0), ("", "x", 0.0, 0.0), ("kitten", "sitting", 1 - 3 / 7, 10 / 13), ("ä", "a", 0.0, 0.5), ("same", "same", 1.0, 1.0)])
def test_ratios(spark, a, b, ratio, sums):
    assert one(spark, T.ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(ratio)
    assert one(spark, T.ratio(F.col("a"), F.col("b")), a=b, b=a) == pytest.approx(ratio)
    assert K.ratio(a, b) == pytest.approx(ratio)
    assert one(spark, T.sum_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(sums)


def test_windows(spark):
    assert one(spark, T.fragment_score(F.col("a"), F.col("b")), a="abcd", b="xxabcdxx") == 1.0
    # windows a quarter of eight apart: the best one at an odd place is skipped
    assert one(spark, T.fragment_score(F.col("a"), F.col("b")), a="abcdefgh", b="xabcdefghx") < 1.0
    assert one(spark, T.partial_ratio(F.col("a"), F.col("b")), a="abcdefgh", b="xabcdefghx") == 1.0
    assert one(spark, T.fragment_score(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_refs(spark):
    assert one(spark, T.is_continuation(F.col("a"), F.col("b")), a="2:5", b="2:8")
    assert not one(spark, T.is_next(F.col("a"), F.col("b")), a="2:5", b="3:1")
    assert one(spark, T.is_continuation(F.col("a"), F.col("b")), a="2:5", b="3:3")
    assert one(spark, T.is_continuation(F.col("a"), F.col("b")), a=None, b="3:3")
    assert not one(spark, T.is_next(F.col("a"), F.col("b")), a=None, b="3:3")
    assert tuple(one(spark, T.parse_ref(F.col("a")), a="2:5-7")) == (2, 5, 7)
    assert tuple(one(spark, T.file_range(F.col("a")), a="CORPUS_112_001_004.WAV")) == (112, 1, 4)
    assert one(spark, T.file_range(F.col("a")), a="corpus_112_1_4.wav") is None


def test_word_slice_and_ngrams(spark):
    text = "one  two three four"
    assert one(spark, T.word_slice(F.col("t"), F.lit(1), F.lit(2)), t=text) == "two three"
    assert one(spark, T.word_slice(F.col("t"), F.lit(2), F.lit(99)), t=text) == "three four"
    assert one(spark, T.word_slice(F.col("t"), F.lit(None).cast("int"), F.lit(None).cast("int")), t=text) == text
    assert one(spark, T.ngrams(F.col("t"), 2), t="aaab") == ["aa", "ab"]
    assert one(spark, T.ngrams(F.col("t"), 3), t="ab") == []
