"""Star joins, fallback chains, interval, rule, fuzzy and similarity joins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rollcall.session import saved


def spine(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Fact joined to each (dimension, fact key, dimension key, how), in order. Catalyst picks
    broadcast or merge from the sizes it sees, and prunes columns no one asks for."""
    for dim, left, right, how in dims:
        fact = fact.join(dim, F.col(left) == F.col(right), how)
    return fact


def unmatched(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias("_key")).distinct(), F.col(left) == F.col("_key"), "left_anti")


def matched(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias("_key")).distinct(), F.col(left) == F.col("_key"), "left_semi")


def first_of(df: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], out: str, default: object = None) -> DataFrame:
    """Value of the first lookup that has the row's key: (table, key columns, value column).

    One left join a lookup, each on its own key, never an OR of keys.
    """
    found = []
    for i, (table, keys, value) in enumerate(lookups):
        name = f"_found{i}"
        found.append(F.col(name))
        df = df.join(table.select(*keys, F.col(value).alias(name)).dropDuplicates(list(keys)), list(keys), "left")
    return df.withColumn(out, F.coalesce(*found, F.lit(default))).drop(*[f"_found{i}" for i in range(len(lookups))])


def _on_axis(c: Column, kind: str) -> Column:
    return F.unix_date(c) if kind == "date" else F.unix_micros(c) if kind == "timestamp" else c.cast("long")


def _cover(low: Column, high: Column, levels: int) -> Column:
    """The fewest dyadic bins (level, bin) that together are the numbers from low to high: at
    each level at most one at either end, where the range does not fill its parent."""
    bins = "array<struct<level: int, bin: bigint>>"
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.expr(f"cast(array() as {bins})").alias("bins"))

    def step(x: Column, level: Column) -> Column:
        def bin_if(take: Column, at: Column) -> Column:
            return F.when(take, F.array(F.struct(level.cast("int").alias("level"), at.alias("bin")))).otherwise(F.expr(f"cast(array() as {bins})"))

        left = (x["a"] <= x["b"]) & (x["a"].bitwiseAND(1) == 1)
        a = x["a"] + F.when(left, 1).otherwise(0)
        right = (a <= x["b"]) & (x["b"].bitwiseAND(1) == 0)
        b = x["b"] - F.when(right, 1).otherwise(0)
        done = a > b  # and stays so: halved, the two could meet again
        return F.struct(F.when(done, 0).otherwise(F.shiftright(a, 1)).alias("a"), F.when(done, -1).otherwise(F.shiftright(b, 1)).alias("b"), F.concat(x["bins"], bin_if(left, x["a"]), bin_if(right, x["b"])).alias("bins"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda x: x["bins"])


def valid_at(df: DataFrame, spans: DataFrame, key: str | None, when: str, value: str, order: str) -> DataFrame:
    """Left join to the first span (by ``order``, then value) with start <= when <= end, of the
    same key where one is named: adds ``value``, ``span_start`` and ``span_end``.

    ``spans(key, start, end, value, order)``; null bounds are open; ``when`` is an integer, a
    date or a timestamp. Spans are cut into bins that double in size from level to level, so a
    long one is a few coarse bins. All points in a bin lie in each of its spans, so a bin keeps
    only its first one, and a point looks into one bin a level: no pair of a point and a span
    is ever made that does not stand for a bin, with one hot key, or none, as with many.
    """
    kind = df.schema[when].dataType.typeName()
    at = df.select(*([F.col(key).alias("_key")] if key else [F.lit(0).alias("_key")]), F.col(when).alias("_when")).where("_key is not null and _when is not null").distinct()
    at = at.withColumn("_at", _on_axis(F.col("_when"), kind))
    low, high = at.agg(F.min("_at"), F.max("_at")).first()
    low, high = (0, -1) if low is None else (low, high)
    levels = max(0, high - low).bit_length()
    s = spans.select(*([F.col(key).alias("_key")] if key else [F.lit(0).alias("_key")]), F.struct(F.col(order).alias("order"), F.col(value).alias("value"), F.col("start").alias("start"), F.col("end").alias("end")).alias("_first"))
    a, b = (F.coalesce(_on_axis(F.col(f"_first.{c}"), kind), F.lit(d)) for c, d in (("start", low), ("end", high)))
    cut = s.withColumns({"_a": F.greatest(a, F.lit(low)) - F.lit(low), "_b": F.least(b, F.lit(high)) - F.lit(low)}).where("_a <= _b")
    bins = cut.withColumn("_bin", F.explode(_cover(F.col("_a"), F.col("_b"), levels))).groupBy("_key", F.col("_bin.level").alias("_level"), F.col("_bin.bin").alias("_bin")).agg(F.min("_first").alias("_first"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    asked = at.withColumn("_level", level).withColumn("_bin", F.expr("shiftright(_at - %d, _level)" % low))
    found = asked.join(bins, ["_key", "_level", "_bin"]).groupBy("_key", "_when").agg(F.min("_first").alias("_first"))
    same = F.col(when) == F.col("_when")
    joined = df.join(found, (F.col(key) == F.col("_key")) & same if key else same, "left")
    return joined.select(*df.columns, F.col("_first.value").alias(value), F.col("_first.start").alias("span_start"), F.col("_first.end").alias("span_end"))


def public_value(df: DataFrame, observed: str, verified: str, span_start: str, span_end: str, when: str) -> DataFrame:
    """Observed value wins; a silent row takes the verified one, marked tentative where the
    span is open and the year lies after its start; without either null. Adds value, basis."""
    silent, given = F.col(observed).isNull(), F.col(verified).isNotNull()
    tentative = F.col(span_end).isNull() & (F.col(when) > F.col(span_start))
    value = F.when(~silent, F.col(observed)).when(given & tentative, F.concat(verified, F.lit(" (?)"))).when(given, F.col(verified))
    basis = F.when(~silent, "programme").when(given & tentative, "inferred_continuation").when(given, "verified")
    return df.withColumns({"value": value, "basis": basis})


def match_rules(df: DataFrame, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rows, label): each row with each label of which a pattern matches. Rules are few and
    fixed, so they fold into one array expression and no join is made at all."""
    labels = list(dict.fromkeys(label for label, _ in rules))
    hits = [F.when(F.col(text).rlike("|".join(f"(?:{p})" for at, p in rules if at == label)), label) for label in labels]
    return df.withColumn("label", F.explode(F.array_compact(F.array(*hits))))


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two texts as difflib counts it: twice the matching blocks over both
    lengths. Null for a null text, and below ``least``, which two upper bounds (lengths, then
    shared characters) mostly settle without looking for blocks."""

    def one(p: str | None, q: str | None) -> float | None:
        if p is None or q is None:
            return None
        m = SequenceMatcher(None, p, q)
        if least and (m.real_quick_ratio() < least or m.quick_ratio() < least):
            return None
        r = m.ratio()
        return r if r >= least else None

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def best_match(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, left_text: str, right_text: str, threshold: float = 0.55) -> DataFrame:
    """For each left row the most similar right row of its block, at least ``threshold``.
    Ties go to the smaller right id. Only pairs of a block are ever compared, and of these
    only those whose lengths allow the threshold reach Python."""
    pairs = left.select(block, left_id, left_text).join(right.select(block, right_id, right_text), block)
    n, m = F.char_length(left_text), F.char_length(right_text)
    near = pairs.where((2 * F.least(n, m) >= threshold * (n + m)) & (n + m > 0))
    scored = near.withColumn("score", ratio(F.col(left_text), F.col(right_text), threshold)).where("score is not null")
    return scored.groupBy(left_id).agg(F.min_by(right_id, F.struct(-F.col("score"), F.col(right_id))).alias(right_id), F.max("score").alias("score"))


def candidates(aliases: DataFrame, targets: DataFrame, block: str, alias: str, target: str, score: Column, n: int = 5) -> DataFrame:
    """Scored pairs of a block, best n an alias, with a flag where the best score is shared."""
    pairs = aliases.join(targets, block).withColumn("score", score).where("score > 0")
    w = Window.partitionBy(alias).orderBy(F.col("score").desc(), F.col(target))
    out = pairs.withColumn("rank", F.row_number().over(w)).withColumn("ambiguous", F.count("*").over(Window.partitionBy(alias, "score")) > 1)
    return out.where(F.col("rank") <= n)


#: Rows of a side that a task of ``rule_pairs`` cuts into bins.
TASK_TARGETS = 50_000


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """The rows over as many tasks as they ask for: a small file of many rows is one task."""
    return df.repartition(max(1, -(-df.count() // TASK_TARGETS)), by)


def _first(df: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """The first n rows of a key; each task keeps no more of it before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where(F.col("_r") <= n).drop("_r")


def rule_pairs(aliases: DataFrame, targets: DataFrame, block: str, alias: str, target: str, same: Mapping[tuple[str, str], int], near: tuple[str, str, float, int], n: int = 5, levels: int = 10) -> DataFrame:
    """The pairs among which ``rule_candidates`` finds the best n of an alias, with scores.

    A target that is among the best is also, of those that meet the same rules at least, among
    the first n by id: whatever comes before it there scores as much or more. So each set of
    rules asks for n + 1 targets by id (one more shows a shared score), never for all. Equal
    columns are a key. The band is cut into cells, 2^levels to a width; dyadic bins of cells keep
    their first n + 1 targets, and an alias looks into the bins that cover the cells wholly
    within its band. Cells at the rim are looked through by distinct value and checked. Rows are
    dealt over tasks by their number first, since each gives a row a level.
    """
    a_col, t_col, width, points = near
    reach, keep = 1 << levels, n + 1
    cell = lambda c: F.floor(F.col(c) / F.lit(width / reach)).cast("long")
    close = F.abs(F.col(a_col) - F.col(t_col)) < width
    a_all, t_all = _dealt(aliases.where(F.col(block).isNotNull()), alias), _dealt(targets.where(F.col(block).isNotNull()), target)
    columns = [*aliases.columns, *[c for c in targets.columns if c != block]]
    found = []
    for size in range(len(same) + 1):
        for chosen in combinations(same, size):
            key = lambda df, side: df.dropna(subset=[c[side] for c in chosen] or [block]).withColumn("_k", F.struct(F.col(block).alias("b"), *[F.col(c[side]).alias(f"c{i}") for i, c in enumerate(chosen)]))  # noqa: E731, B023
            a, t = key(a_all, 0), key(t_all, 1).drop(block)
            if chosen:
                found.append(a.join(_first(t, ["_k"], target, keep), "_k").select(*columns))
            a, t = (x.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).withColumn("_u", cell(c)) for x, c in ((a, a_col), (t, t_col)))
            at = F.explode(F.sequence(F.lit(0), F.lit(levels + 1)))
            bins = _first(t.withColumn("_level", at).withColumn("_bin", F.expr("shiftright(_u, _level)")), ["_k", "_level", "_bin"], target, keep).drop("_u")
            asked = a.withColumn("_c", F.explode(_cover(F.col("_u") - (reach - 2), F.col("_u") + (reach - 2), levels + 1)))
            asked = asked.withColumns({"_level": F.col("_c.level"), "_bin": F.col("_c.bin")})
            found.append(asked.join(bins, ["_k", "_level", "_bin"]).select(*columns))
            rim = F.explode(F.array(*[F.col("_u") + side * (reach + d) for side in (-1, 1) for d in (-1, 0, 1)]))
            values = _first(t, ["_k", "_u", t_col], target, keep)
            found.append(a.withColumn("_u", rim).join(values, ["_k", "_u"]).where(close).select(*columns))
    score = sum((F.when(F.col(x) == F.col(y), p).otherwise(0) for (x, y), p in same.items()), F.when(close, points).otherwise(0))
    return reduce(DataFrame.unionByName, found).dropDuplicates([alias, target]).withColumn("score", score)


def rule_candidates(aliases: DataFrame, targets: DataFrame, block: str, alias: str, target: str, same: Mapping[tuple[str, str], int], near: tuple[str, str, float, int], n: int = 5, levels: int = 10) -> DataFrame:
    """The rows that ``candidates`` gives where the score adds positive points of rules, without
    the pairs of a block: what is looked at for an alias does not grow with its block.

    ``same`` maps pairs of columns (alias', target's) to the points for equal values, ``near``
    is (alias' number, target's, width, points) for a difference under the width. Ids are
    unique a side, and only ``block`` is a column of both. Nulls and NaN meet no rule.
    """
    pairs = rule_pairs(aliases, targets, block, alias, target, same, near, n, levels)
    w = Window.partitionBy(alias).orderBy(F.col("score").desc(), F.col(target))
    out = pairs.withColumn("rank", F.row_number().over(w)).withColumn("ambiguous", F.count("*").over(Window.partitionBy(alias, "score")) > 1)
    return out.where(F.col("rank") <= n)


#: Pairs that a task of ``related`` makes.
TASK_SUMS = 2_000_000


def related(features: DataFrame, item: str, feature: str, weight: str, k: int, block: int = 250_000) -> DataFrame:
    """Top k others by summed weight of shared features, through the features, not all pairs:
    (item, other, score, rank), ties to the smaller other.

    Items are cut by range into blocks of some ``block`` cells. A block is sent the items that
    share one of its features, other block by other block, as one list a feature; a task sums
    and keeps the best k of each item as it goes, so that no pair is ever shuffled and a task
    holds two blocks at a time. Rows that repeat count once; rows without an item or a feature
    are left out, and those without a weight add nothing.
    """
    rows = features.select(F.col(item).alias("a"), F.col(feature).alias("f"), F.col(weight).alias("w")).where("a is not null and f is not null")
    many = max(1, -(-rows.count() // block))
    cells = rows.repartitionByRange(many, "a").distinct().groupBy("a", "f").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.count("*").alias("n"))
    kind, score = cells.schema["a"].dataType.simpleString(), cells.schema["w"].dataType.simpleString()
    cells = saved(cells).withColumn("i", F.spark_partition_id())
    tasks = max(many, features.sparkSession.sparkContext.defaultParallelism)
    lists = cells.select("i", "a", "f", F.col("w").cast("double"), F.col("n").cast("double")).repartition(tasks, "f").groupBy("f", "i").agg(F.collect_list(F.struct("a", "w", "n")).alias("x"))
    lists = saved(lists.select("f", "i", F.col("x.a").alias("a"), F.col("x.w").alias("w"), F.col("x.n").alias("n")))
    own = lists.select("i", F.lit(-1).alias("j"), "f", "a", F.col("w").alias("x"))
    others = lists.select(F.col("i").alias("j"), "f", "a", F.col("n").alias("x")).join(lists.select("i", "f"), "f").select("i", "j", "f", "a", "x")

    def unlisted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = t["a"].combine_chunks()
        f = np.repeat(t["f"].to_numpy(), a.value_lengths().to_numpy())
        return f, a.flatten().to_numpy(zero_copy_only=False), t["x"].combine_chunks().flatten().to_numpy()

    def sums(mine: tuple, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, sum, names of columns) of a block with another."""
        known, first, long, row, w = mine
        f, a, n = unlisted(t)
        names, column = np.unique(a, return_inverse=True)
        at = np.minimum(np.searchsorted(known, f), len(known) - 1)  # each is a feature of the block
        upto, lo, found = np.cumsum(long[at]), 0, []
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TASK_SUMS)))
            times = long[at[lo:hi]]
            cell = np.repeat(first[at[lo:hi]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            code, place = np.unique(row[cell] * len(names) + np.repeat(column[lo:hi], times), return_inverse=True)
            found.append((code, np.bincount(place, w[cell] * np.repeat(n[lo:hi], times))))
            lo = hi
        code, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return code // len(names), code % len(names), np.bincount(place, np.concatenate([x for _, x in found])), names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, mine, items, best = None, [], None, None, None

        def met() -> None:
            nonlocal mine, items, best
            t = pa.Table.from_batches(held)
            if key[1] < 0:
                f, a, w = unlisted(t)
                items, row = np.unique(a, return_inverse=True)
                order = np.argsort(f, kind="stable")
                known, long = np.unique(f, return_counts=True)
                mine, best = (known, np.cumsum(long) - long, long, row[order], w[order]), None
                return
            row, column, x, names = sums(mine, t)
            other = names[column]
            kept = items[row] != other
            row, other, x = row[kept], other[kept], x[kept]
            if best is not None:
                row, other, x = (np.concatenate(c) for c in zip(best, (row, other, x)))
            place = np.unique(other, return_inverse=True)[1]
            order = np.lexsort((place, -x, row))
            row, other, x = row[order], other[order], x[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = row[rank < k], other[rank < k], x[rank < k]

        def out() -> pa.RecordBatch:
            row, other, x = best if best is not None else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            return pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip((items[row], other, x, rank), wanted)] if len(row) else [pa.array([], f.type) for f in wanted], schema=wanted)

        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(i)]
            for lo, hi in zip(cuts, cuts[1:]):
                now = (int(i[lo]), int(j[lo])) if hi > lo else key
                if key is not None and now != key:
                    met()
                    held = []
                    if now[0] != key[0]:
                        yield out()
                key = now
                held.append(batch.slice(lo, hi - lo))
        if key is not None:
            met()
            yield out()

    columns = f"{item} {kind}, other {kind}, score {score}, rank int"
    wanted = to_arrow_schema(StructType.fromDDL(columns))
    return own.unionByName(others).repartition(tasks, "i").sortWithinPartitions("i", "j").mapInArrow(run, columns)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status, changed): added, removed, changed or same; keys not unique on a side are
    left out as ambiguous (see quality.duplicated)."""
    def unique(df: DataFrame, tag: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        kept = df.withColumn("_n", n).where("_n = 1")
        return kept.select(F.col(key), F.struct(*fields).alias(tag))

    both = unique(before, "_b").join(unique(after, "_a"), key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col("_b")[f].eqNullSafe(F.col("_a")[f]), f) for f in fields]))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(key, status.alias("status"), F.when(status == "changed", F.array_join(differ, ",")).otherwise("").alias("changed"))


def staged_match(old: DataFrame, new: DataFrame, old_id: str, new_id: str, exact: Sequence[str], loose: Sequence[str], prefix: tuple[str, int]) -> DataFrame:
    """(old id, new id, stage): first by the exact key where it is unique on both sides, then,
    among what is left, by the loose key and an equal prefix of a text column."""
    def unique(df: DataFrame, keys: Sequence[str | Column], ident: str, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(ident).alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")

    one = unique(old, exact, old_id, "old").join(unique(new, exact, new_id, "new"), list(exact)).select("old", "new", F.lit("exact").alias("stage"))
    left = old.join(one, F.col(old_id) == F.col("old"), "left_anti")
    right = new.join(one, F.col(new_id) == F.col("new"), "left_anti")
    keys = [*loose, F.substring(F.lower(prefix[0]), 1, prefix[1]).alias("_prefix")]
    two = unique(left, keys, old_id, "old").join(unique(right, keys, new_id, "new"), [*loose, "_prefix"]).select("old", "new", F.lit("loose").alias("stage"))
    return one.unionByName(two)
