"""Words are counted inside their rows: what is shuffled are sums by word, not words."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollcall.functions import stems
from rollcall.operators import lexical
from rollcall.plans.all import QUERIES
from tests.conftest import SMALL

ROWS = [(1, "en", ["walks", "walked", "walks", "sea"]), (2, "en", ["walk", "walked"]), (3, "fr", ["walks", "maisons"]), (4, None, ["walks"]), (5, "en", None), (6, "en", []), (1, "en", ["walking", "sun"]), (None, "fr", ["maison"]), (None, "fr", ["maisons"])]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc long, lang string, words array<string>")


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stems_of_a_document_count_once(spark):
    stem = {(r.lang, r.term): r.stem for r in stems.stem_table(docs(spark).where("lang is not null").select("lang", F.explode("words").alias("term")), "lang", "term").collect()}
    tf, df, words = Counter(), {}, {}
    for d, lang, ws in ROWS:
        for w in ws or [] if lang else []:
            key = lang, stem[lang, w]
            tf[key] += 1
            df.setdefault(key, set()).add(d)
            words.setdefault(key, set()).add(w)
    got = lexical.stem_frequencies(docs(spark), "doc", "lang", "words").select("lang", "stem", "tf", "df", "words").collect()
    assert {tuple(r) for r in got} == {(*k, n, len(df[k]), len(words[k])) for k, n in tf.items()} and len(got) == len(tf)


def test_sides_of_repeated_documents(spark):
    got = {r.term: (r.z, r.r, r.df) for r in lexical.log_odds(docs(spark), "doc", "words", F.col("lang") == "en", least=1).collect()}
    assert got["walks"] == (2, 1, 2) and got["maisons"] == (0, 2, 2) and got["walked"] == (2, 0, 2)


@pytest.mark.parametrize("name,most", [("t02_bigrams", 0), ("t03_stem_frequencies", 2)])
def test_words_are_not_shuffled(spark, name, most):
    assert exchanged(QUERIES[name](spark, SMALL)) <= most
