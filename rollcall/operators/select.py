"""Predicates, buckets and set operations as Column expressions and DataFrame steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(c: str) -> Column:
    """Text that is not null and not blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """True if the text holds any of the substrings; folded into one expression."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in patterns], F.lit(False))


def all_tokens(text: Column, query: str) -> Column:
    """True if every blank-separated token of the query occurs in the text, case aside."""
    return reduce(lambda a, b: a & b, [F.lower(text).contains(q) for q in query.lower().split()], F.lit(True))


def membership(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), "both").when(a > 0, "only_a").when(b > 0, "only_b").otherwise("none")


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str, inclusive: bool = True) -> Column:
    """First label whose upper bound the value does not pass; null stays null."""
    out = None
    for bound, label in steps:
        test = value <= bound if inclusive else value < bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(value.isNotNull(), out.otherwise(otherwise))


def by_ranges(df: DataFrame, value: str, ranges: DataFrame, label: str = "label") -> DataFrame:
    """Label of the closed range [lo, hi] that holds the value; a null bound is open.

    ``ranges(lo, hi, label)`` is a rule table of fixed size, so it is broadcast.
    """
    lo, hi = F.coalesce(F.col("lo"), F.col(value)), F.coalesce(F.col("hi"), F.col(value))
    return df.join(F.broadcast(ranges), F.col(value).between(lo, hi), "left").drop("lo", "hi").withColumnRenamed("label", label)


def anniversaries(df: DataFrame, year: str, first: int, last: int, marks: Sequence[int]) -> DataFrame:
    """A row for each year in [first, last] that is one of ``marks`` years after ``year``."""
    wide = df.withColumn("mark_year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return wide.withColumn("mark", F.col("mark_year") - F.col(year)).where(F.col("mark").isin(*marks))


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1; lower counts as 1) in a total order."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; Spark limits within partitions before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def keep_best(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, key, order, 1, "_best").drop("_best")


def merge_reasons(parts: Sequence[DataFrame], key: str, priority: str, reason: str) -> DataFrame:
    """Union of prioritised selections: smallest priority, all reasons in order of priority."""
    every = reduce(DataFrame.unionByName, parts)
    listed = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(priority, reason))), lambda r: r[reason]), "; ")
    return every.groupBy(key).agg(F.min(priority).alias(priority), listed.alias(reason))
