"""Debuts, cohorts, newcomers, survival and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.aggregates import pct
from rollcall.session import saved


def first_seen(df: DataFrame, person: str, year: str, value: str) -> DataFrame:
    """First year of each person and the value of that row, ties by value."""
    return df.groupBy(person).agg(F.min(F.struct(year, value)).alias("_m")).select(person, F.col(f"_m.{year}").alias("debut_year"), F.col(f"_m.{value}").alias("debut_value"))


def newcomers(df: DataFrame, series: str, year: str, person: str) -> DataFrame:
    """Share of each year's persons whose first year in the series it is."""
    pairs = df.select(series, year, person).distinct()
    debut = pairs.withColumn("_d", F.min(year).over(Window.partitionBy(series, person)))
    out = debut.groupBy(series, year).agg(F.count(F.when(F.col("_d") == F.col(year), 1)).alias("newcomers"), F.count("*").alias("total"))
    return out.withColumn("newcomer_pct", pct(F.col("newcomers"), F.col("total")))


def cohort_survival(df: DataFrame, series: str, year: str, person: str) -> DataFrame:
    """Of each debut cohort the persons active so many years later, and their share."""
    pairs = df.select(series, year, person).distinct().withColumn("debut_year", F.min(year).over(Window.partitionBy(series, person)))
    active = pairs.groupBy(series, "debut_year", (F.col(year) - F.col("debut_year")).alias("years_since")).agg(F.count("*").alias("active_n"))
    size = F.max(F.when(F.col("years_since") == 0, F.col("active_n"))).over(Window.partitionBy(series, "debut_year"))
    return active.withColumn("cohort_size", size).withColumn("survival_pct", pct(F.col("active_n"), F.col("cohort_size")))


def retention(df: DataFrame, person: str, year: str, group: Column) -> DataFrame:
    """Share of persons with at least two distinct years, by a group of persons."""
    by = df.groupBy(group.alias("grp"), person).agg(F.countDistinct(year).alias("k"))
    return by.groupBy("grp").agg(F.count("*").alias("persons"), F.count(F.when(F.col("k") >= 2, 1)).alias("retained")).withColumn("retention_pct", pct(F.col("retained"), F.col("persons")))


def debut_split(df: DataFrame, person: str, order: Sequence[str], category: str) -> DataFrame:
    """Rows by category, split into each person's first row (in a total order) and the rest."""
    first = F.row_number().over(Window.partitionBy(person).orderBy(*order)) == 1
    return df.withColumn("_first", first).groupBy(category).agg(F.count(F.when(F.col("_first"), 1)).alias("debut"), F.count(F.when(~F.col("_first"), 1)).alias("again"))


def eras(df: DataFrame, year: str, cutoff: int, category: str, item: str) -> DataFrame:
    """Distinct items by category up to and after a cutoff, with shares of each era."""
    n = df.groupBy(category).agg(F.countDistinct(F.when(F.col(year) <= cutoff, F.col(item))).alias("early"), F.countDistinct(F.when(F.col(year) > cutoff, F.col(item))).alias("late"))
    total = n.agg(F.sum("early").alias("_e"), F.sum("late").alias("_l"))
    out = n.crossJoin(F.broadcast(total))  # one row
    return out.withColumns({"early_pct": pct(F.col("early"), F.col("_e")), "late_pct": pct(F.col("late"), F.col("_l"))}).drop("_e", "_l")


def running_totals(df: DataFrame, person: str, period: str, top: int) -> DataFrame:
    """Cumulative rows of the ``top`` most active persons over every period there is."""
    best = df.groupBy(person).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), person).limit(top).select(person)
    periods = df.select(period).distinct()
    grid = periods.crossJoin(F.broadcast(best))  # top persons by calendar periods
    n = df.join(F.broadcast(best), person, "left_semi").groupBy(person, period).agg(F.count("*").alias("n"))
    full = grid.join(n, [person, period], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(person).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("running", F.sum("n").over(w))


def positions(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Place within the group, group size, first and last flags."""
    w = Window.partitionBy(group)
    out = df.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return out.withColumns({"is_first": F.col("position") == 1, "is_last": F.col("position") == F.col("total")})


def segments(df: DataFrame, group: str, order: Sequence[str], starts: Column, text: str, sep: str = " ") -> DataFrame:
    """Records opened by a start row and continued by those after it; rows before the first
    start form record 0. The state machine is a running sum."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), sep)
    return marked.groupBy(group, "record").agg(F.count("*").alias("lines"), joined.alias("text"))


def carried(df: DataFrame, group: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Last non-null value so far, carried down the ordered rows."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def cumulative(df: DataFrame, order: Sequence[str], value: str, out: str = "running") -> DataFrame:
    """Running sum in a total order over all rows, without one task that sees them all: rows
    are range partitioned, and a table of sums by partition gives each its offset."""
    parts = saved(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    run = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_s", run)
    sums = parts.groupBy("_p").agg(F.max_by("_s", F.struct(*order)).alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offset = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    return parts.join(F.broadcast(offset), "_p").withColumn(out, F.col("_s") + F.col("_o")).drop("_p", "_s", "_o")


def wrapped_entries(df: DataFrame, group: str, order: str, line: str, starts: str, heading: str) -> DataFrame:
    """(group, entry, line): lines of a programme that were wrapped, put together again.

    An entry begins at a line that ``starts`` matches, at a heading and after one; any other
    line continues the entry before it. Blank and null lines are left out. A group's lines
    are read in one order, so groups are documents, not tables.
    """
    w = Window.partitionBy(group).orderBy(order)
    rows = df.where(F.trim(line) != "").withColumn("_head", F.col(line).rlike(heading))
    first = F.col(line).rlike(starts) | F.col("_head") | F.coalesce(F.lag("_head").over(w), F.lit(True))
    rows = rows.withColumn("_first", first).withColumn("entry", F.sum(F.col("_first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(line).alias("_l")))), lambda x: x["_l"])
    return rows.groupBy(group, "entry").agg(F.array_join(text, " ").alias(line))
