from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as X
from lexigrid.sources.files import clean


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["a\r\nb\rc", " \t x \t y ", "a\n\n\n\n\nb", "\n\n lead", "", "  nbsp  ", "keep\n\ntwo"])
def test_clean_is_the_same_in_both_forms(spark, raw):
    assert one(spark, raw, X.clean_text) == clean(raw)


def test_tokenize_is_ascii_and_lower(spark):
    assert one(spark, "Élan-Vital, 12(b) the THE", X.tokenize) == ["lan", "vital", "12", "b", "the", "the"]
    assert one(spark, "", X.tokenize) == []


def test_stop_words_keep_order_and_repeats(spark):
    assert one(spark, "b the a b the", lambda c: X.tokenize(c, ["the"])) == ["b", "a", "b"]
    assert "the" in X.english_stopwords(spark)


def test_token_count_and_preview(spark):
    assert one(spark, "  a\tb \n c d ", X.token_count) == 4
    assert one(spark, "x" * 300, X.preview) == "x" * 300
    assert one(spark, "x" * 301, X.preview) == "x" * 300 + "..."
