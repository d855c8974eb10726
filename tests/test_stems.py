import pytest
from pyspark.sql import functions as F

from rollcall.functions import stems


def plain(word, lang):
    fit = [e for e in stems.endings(lang) if word.endswith(e) and len(word) - len(e) >= stems.LEAST] if lang in stems.ENDINGS else []
    if not fit:
        return word
    e = max(fit, key=len)
    return word[: len(word) - len(e)] + stems.endings(lang)[e]


WORDS = ["studies", "study", "running", "ran", "sing", "ring", "nations", "creations", "kindness", "es", "sés", "maisons", "nationaux", "heureuses", "freundlichkeiten", "bewegung", "kindern", "canciones", "rápidamente", "amado", "übungen", "été", "a"]


def test_longest_ending_goes(spark):
    rows = [(k, w) for k in [*stems.ENDINGS, "xx"] for w in WORDS]
    df = spark.createDataFrame(rows, "lang string, word string")
    got = {(x.lang, x.word): x.s for x in df.select("lang", "word", stems.stem(F.col("word"), F.col("lang")).alias("s")).collect()}
    assert got == {(k, w): plain(w, k) for k, w in rows}
    assert got["en", "studies"] == got["en", "study"] and got["en", "sing"] == "sing"


def test_joined_back_once_a_word(spark):
    df = spark.createDataFrame([("en", "walks")] * 3 + [("en", "walked"), (None, "walks"), ("en", None)], "lang string, word string")
    assert stems.stem_table(df, "lang", "word").where("word is not null").count() == 3
    assert sorted(str(tuple(x)) for x in stems.stemmed(df, "lang", "word").collect()) == sorted(["('en', 'walks', 'walk')"] * 3 + ["('en', 'walked', 'walk')", "(None, 'walks', 'walks')", "('en', None, None)"])
    assert stems.stemmed(df.limit(0), "lang", "word").count() == 0


@pytest.mark.parametrize("lang", list(stems.ENDINGS))
def test_endings_are_letters(lang):
    assert all(e.isalpha() for e in stems.endings(lang))
