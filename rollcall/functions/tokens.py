"""Tokens and bigrams as array expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column, phrases: Sequence[str] = (), canonical: dict[str, str] | None = None, stop: Sequence[str] = (), least: int = 3,
           letters: str = "a-zà-öø-ÿа-яё", stems: Sequence[str] = ()) -> Column:
    """Lower-cased words: phrases kept whole, canonical forms, then stop words, Roman numerals
    and short words dropped. ``stems`` are endings cut from words that stay long enough."""
    t = F.lower(c)
    for p in phrases:
        t = F.replace(t, F.lit(p), F.lit(p.replace(" ", "_")))
    if not stems and not canonical:  # one expression finds the words that stay, without a function on each
        gone = "|".join(["[ivxlcdm]+", *(re.escape(w) for w in stop)])
        return F.regexp_extract_all(t, F.lit(f"(?<![{letters}_])(?!(?:{gone})(?![{letters}_]))([{letters}_]{{{least},}})"), F.lit(1))
    words = F.regexp_extract_all(t, F.lit(f"([{letters}_]+)"), F.lit(1))
    for ending in (f"(?<=.{{{least}}}){e}$" for e in stems):
        words = F.transform(words, lambda w: F.regexp_replace(w, ending, ""))
    if canonical:
        table = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return F.filter(words, lambda w: (F.char_length(w) >= least) & ~w.rlike("^[ivxlcdm]+$"))


def bigrams(words: Column) -> Column:
    """Neighbouring unequal words joined by a blank. The words are found once."""
    return bound(words, lambda w: F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.when(a != b, F.concat(a, F.lit(" "), b))), lambda p: p.isNotNull()))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a lambda's argument, unlike an expression
    that is put in its place, is not evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(words: Column) -> Column:
    """(term, n) of each distinct word of an array, counted inside the row: equal words stand
    together once sorted, so a count is the way to where the next word begins."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return bound(starts, lambda s: F.transform(s, lambda a, k: F.struct(F.get(w, a).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w)) - a).cast("long").alias("n"))))

    return F.coalesce(bound(F.sort_array(words), runs), F.expr("cast(array() as array<struct<term: string, n: bigint>>)"))
