"""Language ID on small and odd tables: nothing held out, nothing to learn, repeated ids."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import langid

KIND = "doc_id long, text string, lang string, source string, n_chars long"
EN, FR = "the river and the house by the stone road", "la maison et le chemin de pierre dans les champs"


def table(spark, rows):
    return spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], KIND)


def ids_of_fold(*folds, n=400):
    return [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 in folds]


def told(df):
    rows = langid.identify(df).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    return {r.lang_pred for r in rows}


@pytest.mark.parametrize("folds", [(2, 3), (1,), (0, 1), (0, 4)])
def test_without_some_folds(spark, folds):
    ids = ids_of_fold(*folds)[:40]
    assert told(table(spark, [(i, f"{EN} {i}" if i % 2 else f"{FR} {i}", "en" if i % 2 else "fr") for i in ids])) == {"en", "fr"}


@pytest.mark.parametrize("rows", [
    [(i, "12345", "en") for i in range(39)],
    [(i, EN, "en") for i in ids_of_fold(0)],
    [(i, EN, None) for i in range(20)],
    [(None, EN, "en")] * 5,
    [(i, None, "en") for i in range(9)],
])
def test_nothing_to_learn(spark, rows):
    assert told(table(spark, rows)) == {"und"}
    kept = langid.accepted(table(spark, rows)).count()
    assert kept == sum(any(c.isalpha() for c in t or "") for _, t, _ in rows)


@pytest.mark.parametrize("one", [2, 13, 14])
def test_one_id_many_times(spark, one):
    same = table(spark, [(one, EN, "en")] * 4000)
    model = langid.fit(same)
    assert model["names"] == (["en"] if zlib.crc32(str(one).encode()) % 5 else [])
    unlike = table(spark, [(one, f"{EN} {i}", "en") for i in range(4000)] + [(7, FR, "fr"), (8, FR, "fr")])
    rows = langid._rows(unlike, "doc_id", "text", "lang").where("fold <> 0")
    names, sample = langid._sample(rows, 1500, 200)
    counts = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert all(n <= 1500 for n in counts.values()) and counts.get("en", 1500) == 1500
    told(unlike)


def test_one_class(spark):
    assert told(table(spark, [(i, f"{EN} {i}", "en") for i in range(30)])) == {"en"}


def test_thousands_of_languages(spark):
    df = table(spark, [(i, f"{EN} {i}", f"x{i % 2000}") for i in range(4000)] + [(9000 + i, f"{FR} {i}", "fr") for i in range(60)])
    model = langid.fit(df, most=20)
    assert len(model["names"]) == 20 and "fr" in model["names"]
    assert told(df.limit(300)) <= {f"x{i}" for i in range(2000)} | {"fr"}


def test_pipeline_on_a_few_rows(spark, tmp_path):
    table(spark, [(2, EN, "en"), (3, f"{FR} un", "fr"), (5, "12", "en"), (6, EN + " again", None)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
