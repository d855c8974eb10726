"""Words are found once, whatever is made of them."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions.tokens import bigrams, counted, tokens
from rollcall.plans.all import QUERIES
from tests.conftest import SMALL


def searches(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_bigrams_find_words_once(spark):
    texts = spark.createDataFrame([("sun sea sea sun moon",), ("sun",), ("",), (None,)], "text string")
    got = texts.select(bigrams(tokens(F.col("text"))).alias("b"))
    assert [r.b for r in got.collect()] == [["sun sea", "sea sun", "sun moon"], [], [], None]
    assert searches(got) == 1


@pytest.mark.parametrize("name", ["t02_bigrams", "t04_bigram_frequencies"])
def test_queries_find_words_once(spark, name):
    assert searches(QUERIES[name](spark, SMALL)) == 1
