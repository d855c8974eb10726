"""Stable identifiers: alias folding, sticky numbers, unique slugs, deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import saved


def fold_aliases(df: DataFrame, key: str, aliases: DataFrame, overrides: DataFrame, out: str = "person_key") -> DataFrame:
    """Key replaced by its alias's target; an override of the resulting key wins over both."""
    a = aliases.select(F.col("alias").alias(key), F.col("target").alias("_target")).dropDuplicates([key])
    folded = df.join(a, key, "left").withColumn(out, F.coalesce("_target", F.col(key))).drop("_target")
    o = overrides.select(F.col("alias").alias(out), F.col("target").alias("_over")).dropDuplicates([out])
    return folded.join(o, out, "left").withColumn(out, F.coalesce("_over", F.col(out))).drop("_over")


def sticky_ids(df: DataFrame, key: str, order: Sequence[str], existing: DataFrame) -> DataFrame:
    """(key, public_id): numbers given before are kept; new keys go on from the largest.

    New keys are numbered by a range sort and per-partition counts, so no task sees them all.
    Keys must be unique; ``quality.duplicated`` finds those that are not.
    """
    new = df.join(existing.select(key), key, "left_anti").select(key, *[c for c in order if c != key])
    top = F.broadcast(existing.agg(F.coalesce(F.max("public_id"), F.lit(0)).cast("long").alias("_top")))  # one row
    numbered = numbered_rows(new, order).crossJoin(top)
    return existing.select(key, F.col("public_id").cast("long").alias("public_id")).unionByName(
        numbered.select(key, (F.col("_top") + F.col("number")).alias("public_id")))


def numbered_rows(df: DataFrame, order: Sequence[str], out: str = "number") -> DataFrame:
    """Consecutive numbers from 1 in a total order without a single-partition window.

    Rows are range partitioned and sorted; a table of rows by partition, one number each,
    gives every partition its offset.
    """
    parts = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offset), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_id", "_part", "_at", "_before", "_n")


def unique_slugs(df: DataFrame, base: str, order: Sequence[str], suffix: Column, out: str = "slug") -> DataFrame:
    """Base slug where unique, else base-suffix, and -2, -3 … where that repeats as well."""
    w = Window.partitionBy(base)
    first = df.withColumn("_s", F.when(F.count("*").over(w) > 1, F.concat_ws("-", base, suffix)).otherwise(F.col(base)))
    n = F.row_number().over(Window.partitionBy("_s").orderBy(*order))
    return first.withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 1, F.concat_ws("-", "_s", "_n")).otherwise(F.col("_s"))).drop("_s", "_n")


def stratified_sample(df: DataFrame, strata: Sequence[str], ident: str, seed: str, n: int) -> DataFrame:
    """The n rows of each stratum whose seeded hash comes first."""
    mark = F.sha2(F.concat_ws("|", F.lit(seed), *strata, ident).cast("binary"), 256)
    return df.withColumn("mark", mark).withColumn("pick", F.row_number().over(Window.partitionBy(*strata).orderBy("mark"))).where(F.col("pick") <= n)


def batches(df: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """Rows not done yet, in chunks of ``size`` by key."""
    rest = df.join(done.select(key).distinct(), key, "left_anti")
    return numbered_rows(rest, [key]).withColumn("batch", F.floor((F.col("number") - 1) / size).cast("long")).drop("number")
