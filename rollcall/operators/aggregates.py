"""Grouped measures: memberships, distributions, concentration, shares, fractional counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(n: Column, d: Column, digits: int = 1) -> Column:
    """100 n / d, rounded half up; 0 where d is 0."""
    return F.when(d != 0, F.round(100.0 * n / d, digits)).otherwise(F.lit(0.0))


def activity(df: DataFrame, person: str, item: str, series: str, year: str, a: str, b: str) -> DataFrame:
    """Distinct items, rows in each of two series, first and last year, by person."""
    return df.groupBy(person).agg(
        F.countDistinct(item).alias("total_items"), F.sum(F.when(F.col(series) == a, 1).otherwise(0)).alias("a_rows"),
        F.sum(F.when(F.col(series) == b, 1).otherwise(0)).alias("b_rows"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def _counted(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, v, k, b, n): rows of each value, rows below it, rows of the group. Equal values
    meet in an aggregate first, so that windows see distinct values only."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*group)
    below = F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    return c.withColumn("b", below).withColumn("n", F.sum("k").over(w))


def _has(rank: Column) -> Column:
    """The value stands at this rank, counted from 1."""
    return (F.col("b") < rank) & (rank <= F.col("b") + F.col("k"))


def distribution(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, extremes and exclusive quartiles by group.

    Quartile i stands at i (n + 1) / 4 of the sorted values, between neighbours in
    proportion; groups under four values give their extremes.
    """
    ranked = _counted(df.withColumn(value, F.col(value).cast("double")), group, value)

    def quartile(i: int) -> Column:
        at = i * (F.col("n") + 1) / 4.0
        lo = F.greatest(F.lit(1), F.floor(at))
        share = at - lo
        return F.sum(F.when(_has(lo), F.col("v") * (1 - share)).otherwise(0.0) + F.when(_has(F.least(lo + 1, F.col("n"))), F.col("v") * share).otherwise(0.0))

    middle = F.sum(F.when(_has(F.floor((F.col("n") + 1) / 2)), F.col("v") / 2).otherwise(0.0) + F.when(_has(F.floor((F.col("n") + 2) / 2)), F.col("v") / 2).otherwise(0.0))
    out = ranked.groupBy(*group).agg(F.max("n").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.max("n")).alias("mean"), middle.alias("median"), F.min("v").alias("lo"),
                                     F.max("v").alias("hi"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    return out.withColumns({"q1": F.when(F.col("n") < 4, F.col("lo")).otherwise(F.col("q1")), "q3": F.when(F.col("n") < 4, F.col("hi")).otherwise(F.col("q3"))})


def at_rank(df: DataFrame, group: Sequence[str], value: str, places: dict[str, float]) -> DataFrame:
    """Values at index floor(n q) (from 0, at most n - 1) of the sorted group: floor-index
    quantiles; 0.5 is the low-index, upper-middle median."""
    picks = [F.max(F.when(_has(F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1), F.col("v"))).alias(k) for k, q in places.items()]
    return _counted(df, group, value).groupBy(*group).agg(F.max("n").alias("n"), *picks)


def gini(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """2 sum(i x) / (n sum(x)) - (n + 1) / n over ascending ranks i; 0 where the sum is 0.

    k equal values after b smaller ones have the rank sum k b + k (k + 1) / 2.
    """
    k, v = F.col("k"), F.col("v")
    sums = _counted(df, group, value).groupBy(*group).agg(F.max("n").alias("n"), F.sum(k * v).alias("s"), F.sum(v * (k * F.col("b") + k * (k + 1) / 2)).alias("t"))
    g = F.when(F.col("s") != 0, 2.0 * F.col("t") / (F.col("n") * F.col("s")) - (F.col("n") + 1.0) / F.col("n")).otherwise(F.lit(0.0))
    return sums.select(*group, "n", F.round(g, 6).alias("gini"))


def closedness(df: DataFrame, group: str, person: str, period: str, core: int = 5, distinct_period: bool = True) -> DataFrame:
    """One-timers, core and retained persons in percent, largest count. The grain is distinct
    (person, period) or, with ``distinct_period`` off, rows."""
    n = F.countDistinct(period) if distinct_period else F.count("*")
    by = df.groupBy(group, person).agg(n.alias("k"))
    total = F.count("*")
    share = lambda cond: pct(F.count(F.when(cond, 1)), total)
    return by.groupBy(group).agg(total.alias("persons"), F.sum("k").alias("participations"), share(F.col("k") == 1).alias("one_timer_pct"),
                                 share(F.col("k") >= core).alias("core_pct"), share(F.col("k") >= 2).alias("retained_pct"), F.max("k").alias("most"))


def histogram(df: DataFrame, person: str, item: str, cap: int | None = None) -> DataFrame:
    """Persons by number of distinct items, zero-filled up to the largest (or capped)."""
    by = df.groupBy(person).agg(F.countDistinct(item).alias("k"))
    if cap:
        by = by.withColumn("k", F.least("k", F.lit(cap)))
    counts = by.groupBy("k").agg(F.count("*").alias("persons"))
    every = counts.agg(F.max("k").alias("top")).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias("k"))
    return every.join(counts, "k", "left").select("k", F.coalesce("persons", F.lit(0)).alias("persons"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts and row percentages of fixed column values; the values are given, so no pass is
    needed to find them."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"n_{i}") for i, v in enumerate(values)]
    out = df.groupBy(row).agg(*counts, F.count(F.when(F.col(column).isin(*values), 1)).alias("total"))
    return out.withColumns({f"pct_{i}": pct(F.col(f"n_{i}"), F.col("total")) for i in range(len(values))})


def with_total(df: DataFrame, group: str, label: str, **measures: Column) -> DataFrame:
    """Measures by group and, as ``label``, over all rows, in one pass of grouping sets."""
    out = df.rollup(group).agg(F.grouping(group).alias("_all"), *[c.alias(k) for k, c in measures.items()])
    return out.withColumn(group, F.when(F.col("_all") == 1, label).otherwise(F.col(group))).drop("_all")


def in_scopes(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Each row once for every scope it falls in; scopes may overlap."""
    return df.withColumn("scope", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in scopes.items()]))))


#: Rows that a task of ``fractional`` holds.
TASK_ROWS = 1_000_000


def fractional(df: DataFrame, item: str, author: str, org: str, group: Sequence[str] = ()) -> DataFrame:
    """Simple and fractional counts by organisation: an item gives 1 / (authors x the author's
    organisations) to each (author, organisation); the fractions of an item add up to 1.

    Rows of an item are brought together once, over as many tasks as the rows ask for, and are
    counted there, so what a task holds does not grow with the table; after that only sums by
    organisation move. Rows without an item or an author count for nothing.
    """
    given = df.where(F.col(item).isNotNull() & F.col(author).isNotNull()).select(item, author, org, *group)
    rows = given.repartition(max(8, -(-given.count() // TASK_ROWS)), item).distinct()
    one = F.row_number().over(Window.partitionBy(item, author).orderBy(org, *group)) == 1
    counted = rows.withColumn("_one", F.when(one, 1).otherwise(0)).withColumn("_m", F.count("*").over(Window.partitionBy(item, author)))
    counted = counted.withColumn("_k", F.sum("_one").over(Window.partitionBy(item)))
    each = counted.groupBy(item, org, *group).agg(F.sum(1.0 / (F.col("_k") * F.col("_m"))).alias("_f"))
    return each.groupBy(org, *group).agg(F.count("*").alias("simple_count"), F.round(F.sum("_f"), 4).alias("fractional_count"))


def listed(order: Sequence[str], value: str, sep: str) -> Column:
    """Values joined in a given order, as an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]), sep)


def first_seen(order: Sequence[str], value: str, sep: str) -> Column:
    """Distinct values joined in the order in which they first occur."""
    return F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])), sep)


def settle_variants(df: DataFrame, group: str, value: str, mark: str = " (?)") -> DataFrame:
    """Distinct values by group; a tentative variant (ending in ``mark``) gives way to the
    confirmed one."""
    tentative = F.col(value).endswith(mark)
    base = F.when(tentative, F.substring(value, F.lit(1), F.char_length(value) - len(mark))).otherwise(F.col(value))
    return df.groupBy(group, base.alias("base")).agg(F.min_by(value, tentative).alias("value"))


def drop_prefixes(values: Column) -> Column:
    """An array without the elements that begin another, longer element."""
    return F.filter(values, lambda n: ~F.exists(values, lambda o: (o != n) & o.startswith(n)))


def dominant(df: DataFrame, group: str, category: str, unknown: str) -> DataFrame:
    """Most frequent category, ties by name; ``unknown`` only where there is nothing else."""
    counts = df.groupBy(group, category).agg(F.count("*").alias("n"))
    best = F.min_by(category, F.struct(F.col(category) == unknown, -F.col("n"), F.col(category)))
    return counts.groupBy(group).agg(best.alias(category), F.min_by("n", F.struct(F.col(category) == unknown, -F.col("n"), F.col(category))).alias("n"))


def last_known(df: DataFrame, person: str, year: str, value: str, before: int, accept: Column) -> DataFrame:
    """Latest accepted value before a year, with its year: an as-of lookup as one aggregate."""
    good = accept & (F.col(year) < before)
    return df.groupBy(person).agg(F.max_by(F.when(good, F.col(value)), F.when(good, F.struct(F.col(year), F.col(value)))).alias("value"),
                                  F.max(F.when(good, F.col(year))).alias("as_of"))


def never(df: DataFrame, person: str, has: Column) -> DataFrame:
    """Persons for whom no row has the property."""
    return df.groupBy(person).agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("_any"), F.count("*").alias("n")).where(~F.col("_any")).drop("_any")


def top_text(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k most frequent keys of a group as "key:count; key:count", ties by key."""
    counts = df.groupBy(group, key).agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), key))).where(F.col("r") <= k)
    return top.withColumn("_t", F.concat_ws(":", key, "n")).groupBy(group).agg(listed(["r"], "_t", "; ").alias("top"))


def cosine(df: DataFrame, side: str, key: str, a: str, b: str) -> DataFrame:
    """Cosine of the count vectors of two sides over a key; null if either has no rows."""
    counts = df.groupBy(key).agg(F.count(F.when(F.col(side) == a, 1)).alias("x"), F.count(F.when(F.col(side) == b, 1)).alias("y"))
    sums = counts.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return sums.select(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.round(F.col("xy") / F.sqrt(F.col("xx").cast("double") * F.col("yy")), 6)).alias("cosine"))


def flows(df: DataFrame, steps: Sequence[tuple[str, str]], least: int) -> DataFrame:
    """Link counts (source, target, value) between the columns of each step, at least ``least``."""
    parts = [df.groupBy(F.concat(F.lit(f"{a}:"), F.col(a)).alias("source"), F.concat(F.lit(f"{b}:"), F.col(b)).alias("target")).agg(F.count("*").alias("value")) for a, b in steps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value") >= least)
