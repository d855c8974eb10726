"""Scalar text functions as Column expressions. An Arrow UDF serves only where Spark has no
expression: Unicode compatibility folding and cascades of alternative line layouts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\x0B\f\u00A0\u200B]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function offers."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def canonical(c: Column) -> Column:
    """Compatibility forms composed, lower case, ё as е, white space (no-break and zero-width
    included) collapsed."""
    return F.lower(squeeze(F.translate(nfkc(c), "ёЁ", "еЕ")))


def stable_hash(parts: Sequence[Column], length: int = 10) -> Column:
    """First hex digits of SHA-1 over the canonical parts joined by "|"; null counts as empty."""
    joined = F.concat_ws("|", *[canonical(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])
    return F.substring(F.sha1(joined.cast("binary")), 1, length)


def prefixed_id(prefix: str, parts: Sequence[Column], length: int = 10) -> Column:
    return F.concat(F.lit(prefix), stable_hash(parts, length))


def name_key(c: Column) -> Column:
    """"surname i i" of "Surname, Given Second", "Given Second Surname" or "Surname G. S."."""
    t = canonical(F.regexp_replace(c, r"\.", ". "))
    comma = F.regexp_extract(t, r"^([^,]+),\s*(.+)$", 1)
    given = F.regexp_extract(t, r"^([^,]+),\s*(.+)$", 2)
    dotted = t.rlike(r"^[^. ]+( [^. ]\.)+$")
    words = F.split(F.when(dotted, F.regexp_replace(t, r"\.", "")).when(comma != "", F.concat_ws(" ", comma, given)).otherwise(t), " ")
    last_first = F.when(dotted | (comma != ""), words).otherwise(F.concat(F.slice(words, -1, 1), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))))
    initials = F.transform(F.slice(last_first, 2, 8), lambda w: F.substring(w, 1, 1))
    return F.when(c.isNotNull(), F.array_join(F.concat(F.slice(last_first, 1, 1), initials), " "))


def initials(c: Column) -> Column:
    """"Surname G. S." of a name in any of the layouts that ``name_key`` knows."""
    words = F.split(name_key(c), " ")
    rest = F.transform(F.slice(words, 2, 8), lambda w: F.concat(F.upper(w), F.lit(".")))
    return F.when(c.isNotNull(), F.array_join(F.concat(F.array(F.initcap(F.element_at(words, 1))), rest), " "))


def by_suffix(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first suffix that the text ends in."""
    out = F.lit(default)
    for suffix, label in reversed(rules):
        out = F.when(F.lower(c).endswith(suffix), label).otherwise(out)
    return out


def clean_title(c: Column) -> Column:
    """Without online markers in brackets, clock times at the end and a last full stop."""
    t = F.regexp_replace(c, r"(?i)\s*[\(\[](online|онлайн|zoom)[\)\]]", "")
    t = F.regexp_replace(t, r"\s*\d{1,2}[:.]\d{2}\s*([-–—]\s*\d{1,2}[:.]\d{2})?\s*\.?\s*$", "")
    return F.regexp_replace(squeeze(t), r"\.$", "")


def mend_hyphens(c: Column) -> Column:
    """Words split by a hyphen and a blank put together again."""
    return F.regexp_replace(c, r"([a-zа-яё])-\s+([a-zа-яё])", "$1$2")


def proper_case(c: Column, names: Sequence[str]) -> Column:
    """Listed names restored to their spelling wherever they stand as whole words."""
    return reduce(lambda t, n: F.regexp_replace(t, f"(?iu)(?<![\\p{{L}}]){re.escape(n)}(?![\\p{{L}}])", n), names, c)


def normal_title(c: Column) -> Column:
    """For comparison: lower case, only letters and digits, single blanks."""
    return F.trim(F.regexp_replace(canonical(c), r"[^a-zа-я0-9]+", " "))


def leading_part(c: Column, pattern: str = r"^\(([^)]*)\)\s*(.*)$") -> Column:
    """struct(rest, part): a bracketed part at the start and what follows it."""
    part = F.regexp_extract(c, pattern, 1)
    return F.struct(F.when(part != "", F.regexp_extract(c, pattern, 2)).otherwise(c).alias("rest"), F.when(part != "", part).alias("part"))


def null_if_matches(c: Column, patterns: Sequence[str]) -> Column:
    """Trimmed text, null where blank or where a pattern matches all of it."""
    t = squeeze(c)
    return F.when((t != "") & ~F.lower(t).rlike("^(" + "|".join(patterns) + ")$"), t)


def first_label(c: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """Label of the first rule whose substring the lower-cased text holds."""
    out = F.lit(default)
    for needle, label in reversed(rules):
        out = F.when(F.lower(c).contains(needle), label).otherwise(out)
    return out


def all_labels(c: Column, rules: Sequence[tuple[str, str]], default: str, outranked: dict[str, str] | None = None) -> Column:
    """Labels of all matching expressions; ``outranked`` maps a label to one that suppresses
    it; the default alone where none matches."""
    found = F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), label) for p, label in rules]))
    for weak, strong in (outranked or {}).items():
        found = F.when(F.array_contains(found, strong), F.array_remove(found, weak)).otherwise(found)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def slug(c: Column, letters: dict[str, str] | None = None) -> Column:
    """Transliterated, lower case, runs of anything but letters and digits as one hyphen."""
    t = F.lower(c)
    for k, v in (letters or {}).items():
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def time_interval(c: Column) -> Column:
    """"9.00 - 18.30" as "09:00 – 18:30"; null if it isn't one."""
    p = r"^\s*(\d{1,2})[.:](\d{2})\s*[-–—]\s*(\d{1,2})[.:](\d{2})\s*$"
    part = [F.lpad(F.regexp_extract(c, p, i), 2, "0") for i in range(1, 5)]
    return F.when(c.rlike(p), F.concat(part[0], F.lit(":"), part[1], F.lit(" – "), part[2], F.lit(":"), part[3]))


def weekday(c: Column, missing: str = "Not specified") -> Column:
    return F.coalesce(F.date_format(F.try_to_date(c), "EEEE"), F.lit(missing))


def year_in(c: Column) -> Column:
    """First year from 1400 to 2099 in a text, null without one."""
    found = F.regexp_extract(c, r"(1[4-9][0-9][0-9]|20[0-9][0-9])", 1)
    return F.when(found != "", found).cast("int")


def dated(c: Column, fallback: Column) -> Column:
    """struct(date, exact): the text's date d.m.yyyy or yyyy-mm-dd, or the fallback."""
    iso = F.try_to_date(c, "yyyy-MM-dd")
    local = F.try_to_date(F.regexp_extract(c, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), "d.M.yyyy")
    return F.struct(F.coalesce(iso, local, fallback).alias("date"), (iso.isNotNull() | local.isNotNull()).alias("exact"))


def month_day(c: Column, year: Column, months: dict[str, int]) -> Column:
    """Date of "N month" (by month name) or "N.MM" in a given year."""
    name = F.regexp_extract(F.lower(c), r"(\d{1,2}) (" + "|".join(months) + ")", 2)
    day = F.regexp_extract(F.lower(c), r"(\d{1,2}) (" + "|".join(months) + ")", 1)
    number = F.element_at(F.create_map(*[F.lit(x) for kv in months.items() for x in kv]), F.when(name != "", name))
    d2, m2 = (F.regexp_extract(c, r"(\d{1,2})\.(\d{2})", i) for i in (1, 2))
    named = F.concat(year, F.lit("-"), number, F.lit("-"), F.when(day != "", day))
    return F.coalesce(F.try_to_date(named, "yyyy-M-d"), F.try_to_date(F.concat(year, F.lit("-"), m2, F.lit("-"), F.when(d2 != "", d2)), "yyyy-MM-d"))


def shorten(c: Column, limit: int = 155) -> Column:
    """At most ``limit`` characters, cut at a word, with an ellipsis where cut."""
    t = squeeze(c)
    cut = F.regexp_replace(F.substring(t, 1, limit), r"\s+\S*$", "")
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


#: Formats of external identifiers (fixed values).
FORMATS = {
    "orcid": r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$",
    "wikidata": r"^Q[1-9][0-9]*$",
    "viaf": r"^[1-9][0-9]{1,21}$",
    "ror": r"^0[a-z0-9]{6}[0-9]{2}$",
}


def identifier(c: Column, kind: str) -> Column:
    """Identifier without blanks and without the address before it; null if malformed."""
    t = F.regexp_replace(F.trim(c), r"^https?://[^/]+/(?:[a-z]+/)*", "")
    t = F.upper(t) if kind in ("orcid", "wikidata") else t
    return F.when(t.rlike(FORMATS[kind]), t)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^>]*>", " "))


def coauthors(c: Column) -> Column:
    """Names of "A. Name, B. Other": split at commas before a capital."""
    return F.split(F.trim(c), r"\s*,\s*(?=[A-ZА-ЯЁ])")


_UP, _LOW = "A-ZА-ЯЁ", "a-zа-яё"
#: Tokens of a line: a capital word, an initial; what may follow each before the next one.
_TOKENS = {"W": (f"[{_UP}][{_LOW}-]+", r"\s+"), "I": (rf"[{_UP}]\.", r"\s*")}


def _names(*layouts: str) -> str:
    """Expression for names laid out as one of these rows of tokens, the longest first."""
    def one(layout: str) -> str:
        ends = "" if layout[-1] == "W" else _TOKENS["I"][1]
        return "".join(_TOKENS[t][0] + _TOKENS[t][1] for t in layout[:-1]) + _TOKENS[layout[-1]][0] + ends

    return "(?:" + "|".join(map(one, sorted(layouts, key=len, reverse=True))) + ")"


_BY_INITIALS = ("IW", "IIW", "WI", "WII")
#: "G. S. Surname" or "Surname G. S."; an author may also be "Given Second Surname".
INITIALLED = _names(*_BY_INITIALS)
AUTHOR = _names(*_BY_INITIALS, "WW", "WWW", "WWWW")
#: A bracket after a name that says where someone is from: not the years of a life.
PLACE = r"\((?!\s*\d{4}\s*[–—-])[^()]+\)"
#: Parts of place names (fixed values): such a bracket makes initials before it a speaker
#: even where no full stop ends the title before.
PLACES = ("москв", "спб", "петербург", "обнинск", "казан", "пенза", "краснодар", "новосибирск", "вильнюс", "гамбург", "маврики", "гент", "онлайн")


@F.pandas_udf(T.StructType([T.StructField("speakers", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.StringType())), T.StructField("title", T.StringType())]))
def talk_line(s: pd.Series) -> pd.DataFrame:
    """Speakers, the place of each (null without one) and title of a programme line.

    Groups of authors, "Name, Name (Place)", are read off one after another; a further group
    belongs to the speakers only if it has a place, else the title has begun. Without any
    place, authors must be set off by a colon, a dash or, if written with initials, a full
    stop. A line of no such layout is all title; null gives nulls.
    """
    group = re.compile(rf"\[?(?P<who>{AUTHOR}(?:\s*,\s*{AUTHOR})*)\]?\s*(?P<place>{PLACE})?")
    initialled = re.compile(rf"{INITIALLED}(?:\s*,\s*{INITIALLED})*\s*")
    degree = re.compile(r"(?i)^(?:акад|проф|prof)\.\s*")

    def one(line: str | None) -> tuple[list[str] | None, list[str | None] | None, str | None]:
        if line is None:
            return None, None, None
        text, who, where, at = degree.sub("", " ".join(line.split())), [], [], 0
        while m := group.match(text, at):
            names = [" ".join(w.split()) for w in re.split(r"\s*,\s*", m["who"])]
            rest = text[m.end():]
            if m["place"]:
                who, where, at = who + names, where + [m["place"][1:-1].strip()] * len(names), m.end() + len(rest) - len(rest.lstrip(" .,"))
                continue
            mark = re.match(r"\s*[:—–]\s*|\s*\.\s*" if initialled.fullmatch(m["who"]) or m["who"].endswith(".") else r"\s*[:—–]\s*", rest)
            if not who and (mark or m["who"].endswith(".") and rest):
                who, where, at = names, [None] * len(names), m.end() + (mark.end() if mark else 0)
            break
        if who:
            lead = re.match(r"[\s.,:—–]*", text[at:])
            return who, where, text[at + lead.end():].rstrip(". ")
        return [], [], " ".join(line.split())

    made = [one(x) for x in s]
    return pd.DataFrame({"speakers": [m[0] for m in made], "places": [m[1] for m in made], "title": [m[2] for m in made]})


def packed_lines(c: Column) -> Column:
    """A line that holds several talks, split where the next begins: at a clock time, at a
    name with its place after the full stop of a title, and at initials with a known place.

    Two authors in a row, each with a place, are one talk; a stop that belongs to initials,
    or a name after a comma, begins none.
    """
    cut, name = "\u0001", rf"{AUTHOR}\s*{PLACE}"
    place = rf"\((?iu:[^()]*(?:{'|'.join(PLACES)})[^()]*)\)"
    together = rf"^\s*{AUTHOR}\s*{PLACE}\s*\.\s*{AUTHOR}\s*{PLACE}"
    t = F.regexp_replace(c, r"\s+(?=\d{1,2}[:.]\d{2}\s)", cut)
    split = F.regexp_replace(t, rf"(?<=[^{_UP}][.!?])\s*(?={name})", cut)
    split = F.regexp_replace(split, rf"(?<=[^,.\s\u0001])\s+(?={INITIALLED}\s*{place})", cut)
    out = F.split(F.when(c.rlike(together), t).otherwise(split), cut)
    return F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: x != "")


#: How an entry of a programme begins, and lines that are headings (fixed words).
STARTS = rf"^\s*(?:{AUTHOR}\s*(?:[,(.]|$)|(?:[{_UP}]\.\s*){{1,2}}$|\d{{1,2}}[:.]\d{{2}}\s)"
HEADING = r"(?iu)заседание|секция|перерыв|начало в |session|break|\d{1,2}[:.]\d{2}\s*[-—–]\s*\d{1,2}[:.]\d{2}|^\s*\d{1,2}\s*(?:[—–-]\s*\d{1,2}\s*)?(?:мая|may)"


def capped_score(signals: Sequence[tuple[Column, float]], top: float = 1.0) -> Column:
    return F.least(F.lit(top), reduce(lambda a, b: a + b, [F.when(c, F.lit(float(w))).otherwise(0.0) for c, w in signals]))


def tier(tiers: Sequence[tuple[Column, int]], default: int = 0) -> Column:
    out = F.lit(default)
    for cond, value in reversed(tiers):
        out = F.when(cond, value).otherwise(out)
    return out


def age_proxy(first_year: Column, offset: int, lo: int, hi: int) -> Column:
    """Birth year guessed from a first publication; null outside the plausible window."""
    y = first_year - offset
    return F.when(y.between(lo, hi), y)


def remap(c: Column, values: dict[str, str], default: str | None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def valid_row(domains: dict[str, Sequence[str]], number: str, lo: float, hi: float) -> Column:
    """All enumerated columns within their domains and the number within its range."""
    ok = reduce(lambda a, b: a & b, [F.col(k).isin(*v) for k, v in domains.items()], F.col(number).between(lo, hi))
    return F.coalesce(ok, F.lit(False))
