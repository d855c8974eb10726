"""Order without gathering: sorted range partitions, and one offset for each run in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import saved


def ranged(rows: DataFrame, *by: str | Column, parts: int | None = None) -> DataFrame:
    """``rows`` in sorted range partitions, saved; adds ``part`` and ``pos``, the place in it.

    Rows that are equal in ``by`` are spread by their place in ``rows``, so no value is too
    common for a part; ``rows`` has to be read from files or saved, so that a task that runs
    again sees the same places.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.withColumn("_row", F.monotonically_increasing_id())
    each = each.repartitionByRange(parts, *by, "_row").sortWithinPartitions(*by, "_row").drop("_row")
    return saved(each.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos")))


def runs(placed: DataFrame, key: Sequence[str] = (), size: Column | None = None) -> DataFrame:
    """(part, *key, first, start, total): a row for each run of a key in a part of ``ranged``
    rows that are sorted by the key: the place of its first row, the key's sum of ``size`` (of
    rows, if not given) before the run, and the key's sum. There are as many as parts and keys."""
    each = placed.groupBy("part", *key).agg(F.min("pos").alias("first"), F.sum(F.lit(1) if size is None else size).alias("_size"))
    every = Window.partitionBy(*key)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(c).alias(c) for c in ("part", *key, "first")]  # new columns, which can meet those of ``placed`` again
    return each.select(*own, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("start"), F.sum("_size").over(every).alias("total"))


def each_of(df: DataFrame, low: str, high: str, name: str, chunk: int = 4096) -> DataFrame:
    """A row for each number from ``low`` to below ``high``, in two steps, so that no array is
    longer than ``chunk`` however far apart they are (up to its square for one row)."""
    some = df.where(F.col(low) < F.col(high))
    step = F.greatest(F.lit(chunk), F.ceil((F.col(high) - F.col(low)) / F.lit(chunk)))
    cut = some.withColumn("_step", step.cast("long")).withColumn("_from", F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long") - 1, F.col("_step"))))
    inner = F.sequence(F.col("_from"), F.least(F.col("_from") + F.col("_step"), F.col(high).cast("long")) - 1)
    return cut.withColumn(name, F.explode(inner)).drop("_from", "_step")
