"""Stems of words by rules: the longest known ending of a language is replaced.

The endings of a language are one automaton: an alternation that the regular-expression engine
runs once over a word. Words are few next to the rows of a corpus, so stems are worked out for
distinct words and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that have to stay before an ending.
LEAST = 3

# Endings by language; what follows the colon takes their place.
ENDINGS = {
    "en": "s es ed ing ly ness ment ments er ers ion ions able ible ful less ies:y ied:y ation:ate ations:ate ingly edly",
    "fr": "s e es ée ées er ez ait aient ant ante antes ants ement ements ment ments tion:t tions:t ateur:at ateurs:at eux:eu euse:eu euses:eu ive:if ives:if ifs:if ité ités aux:al",
    "de": "e en er es em ern est st ung ungen heit heiten keit keiten lich liche lichen licher liches ig ige igen iger iges isch ische ischen nd nde nden",
    "es": "s o a os as es ar er ir ando iendo ado ada ados adas ido ida idos idas mente ción:c ciones:c dad dades ar aron ieron ico ica icos icas ivo iva ivos ivas ísimo ísima",
}


def endings(lang: str) -> dict[str, str]:
    """Ending to what takes its place."""
    pairs = (x.partition(":") for x in ENDINGS[lang].split())
    return {a: b for a, _, b in pairs}


def pattern(lang: str) -> str:
    """Finds the longest ending: what stays is as short as it may be."""
    return rf"^.{{{LEAST},}}?({'|'.join(endings(lang))})$"


def stem(word: Column, lang: Column) -> Column:
    """The word without its ending; as it is if it has none or its language is not known."""

    def of(name: str) -> Column:
        found = F.regexp_extract(word, pattern(name), 1)
        kept = F.substring(word, F.lit(1), F.char_length(word) - F.char_length(found))
        new = {a: b for a, b in endings(name).items() if b}
        table = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
        return F.concat(kept, F.coalesce(F.try_element_at(table, found), F.lit("")))

    return reduce(lambda rest, name: F.when(lang == name, of(name)).otherwise(rest), ENDINGS, word)


def stem_table(terms: DataFrame, lang: str, term: str) -> DataFrame:
    """(lang, term, stem) of the distinct words of a table."""
    return terms.select(lang, term).distinct().withColumn("stem", stem(F.col(term), F.col(lang)))


def stemmed(terms: DataFrame, lang: str, term: str) -> DataFrame:
    """``terms`` with ``stem``, worked out once a distinct word. A word of a null language is
    its own stem; a null word has none."""
    known = stem_table(terms.where(F.col(lang).isNotNull()), lang, term)
    return terms.join(known, [lang, term], "left").withColumn("stem", F.coalesce("stem", F.col(term)))
