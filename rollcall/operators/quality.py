"""Audits: reconciliation, dangling and duplicate keys, domains, anomalies, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, severity: str, found: DataFrame) -> DataFrame:
    """(id, severity, count, status) of one check; it passes if nothing is found."""
    return found.agg(F.count("*").alias("count")).select(F.lit(name).alias("id"), F.lit(severity).alias("severity"), "count", F.when(F.col("count") == 0, "pass").otherwise("fail").alias("status"))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def reconcile(pairs: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(id, expected, actual, status) of row counts that have to agree."""
    parts = []
    for name, a, b in pairs:
        one = a.agg(F.count("*").alias("expected")).crossJoin(F.broadcast(b.agg(F.count("*").alias("actual"))))
        parts.append(one.select(F.lit(name).alias("id"), "expected", "actual", F.when(F.col("expected") == F.col("actual"), "pass").otherwise("fail").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def duplicated(df: DataFrame, key: Sequence[str], owner: str | None = None) -> DataFrame:
    """Keys with more than one row, or with more than one owner where one is named."""
    n = F.countDistinct(owner) if owner else F.count("*")
    return df.groupBy(*key).agg(n.alias("n")).where(F.col("n") > 1)


def outside(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values beyond the allowed ones, with their rows."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def rule_failures(df: DataFrame, key: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, rule, value) of present values that miss their pattern: {rule: (column, regex)}."""
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).rlike(p), F.struct(F.lit(name).alias("rule"), F.col(c).cast("string").alias("value"))) for name, (c, p) in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*bad))).alias("x")).select(key, "x.rule", "x.value")


def anomalies(df: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """Rows with at least one reason, all of them listed."""
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in reasons.items()]))
    return df.select(key, F.array_join(found, ",").alias("reasons")).where("reasons <> ''")


def gaps(df: DataFrame, key: str, other: DataFrame, other_key: str, value: str, rank: str) -> DataFrame:
    """Keys without a counterpart value, with the best candidate by rank, if there is one."""
    best = other.groupBy(F.col(other_key).alias(key)).agg(F.max_by(value, F.struct(rank, value)).alias("candidate"))
    return df.join(best, key, "left")


def drift(df: DataFrame, key: str, text: str, expected: str, tolerance: float = 0.05) -> DataFrame:
    """Numbers of a text against the expected one: found anywhere within tolerance or not."""
    numbers = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    ok = F.exists(numbers, lambda x: F.abs(x - F.col(expected)) <= tolerance)
    return df.select(key, expected, F.size(numbers).cast("long").alias("numbers"), F.coalesce(ok, F.lit(False)).alias("agrees"))


def match_rates(df: DataFrame, group: str, matched: Column) -> DataFrame:
    """Matched and unmatched rows with their share, by group and over all."""
    out = df.rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("n"), F.count(F.when(matched, 1)).alias("matched"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(group)).alias(group), "n", "matched", (F.col("n") - F.col("matched")).alias("unmatched"),
                      F.round(100.0 * F.col("matched") / F.col("n"), 1).alias("matched_pct"))


def assertions(df: DataFrame, entity: str, key: str, columns: dict[str, float]) -> DataFrame:
    """Long form (entity_type, entity_id, attribute, value, confidence) of present values."""
    each = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"), F.lit(float(w)).alias("confidence")) for c, w in columns.items()])
    rows = df.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.explode(each).alias("x"))
    return rows.select("entity_type", "entity_id", "x.attribute", "x.value", "x.confidence").where("value is not null")


def widened(facts: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Back to a row an entity: each attribute's value of most confidence, ties by value."""
    pick = [F.max_by(F.when(F.col("attribute") == a, F.col("value")), F.when(F.col("attribute") == a, F.struct("confidence", "value"))).alias(a) for a in attributes]
    return facts.groupBy("entity_type", "entity_id").agg(*pick)


def patched(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-empty new fields overwrite; ``action`` tells added, updated, same or kept rows.
    The last row of a key in ``new`` is not defined: make keys unique first."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, key, "full_outer")
    fresh = {c: F.when(F.trim(F.col(f"_{c}").cast("string")) != "", F.col(f"_{c}")) for c in columns}
    changed = reduce(lambda a, b: a | b, [fresh[c].isNotNull() & ~fresh[c].eqNullSafe(F.col(c)) for c in columns])
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(changed, "updated").otherwise("same")
    return both.select(key, *[F.coalesce(fresh[c], F.col(c)).alias(c) for c in columns], action.alias("action"))


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")
