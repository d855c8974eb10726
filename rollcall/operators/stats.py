"""Contingency, rank, resampling and survival statistics.

Sums run distributed; tail probabilities are worked out on the one row that is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import saved


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function Q(a, x), by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_p(x: float | None, dof: int) -> float | None:
    return None if x is None or dof < 1 else gamma_tail(dof / 2, x / 2)


def chi_square(df: DataFrame, row: str, column: str, yates: bool = True) -> DataFrame:
    """chi2, dof, n, Cramér's V and p of the cross table; a 2 x 2 table gets Yates' correction.

    Only cells that occur are visited: the sum over all cells of (o - e)^2 / e equals that of
    o^2 / e over these, less n. In a 2 x 2 table |o - e| is the same in every cell, so one cell
    and the margins give the corrected sum. With one category on a side dof is 0 and Cramér's
    V and p are null; an empty table gives a row of zeros and nulls.
    """
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").cast("double").alias("o"))
    rows, columns = cells.groupBy(row).agg(F.sum("o").alias("_r")), cells.groupBy(column).agg(F.sum("o").alias("_c"))
    n = cells.agg(F.sum("o").alias("_n")).crossJoin(rows.agg(F.count("*").alias("_i"), F.sum(1 / F.col("_r")).alias("_ir"))).crossJoin(columns.agg(F.count("*").alias("_j"), F.sum(1 / F.col("_c")).alias("_ic")))
    e = F.col("_r") * F.col("_c")
    sums = cells.join(rows, row).join(columns, column).agg(F.sum(F.col("o") * F.col("o") / e).alias("_q"), F.first(F.struct("o", e.alias("e"))).alias("_one"))
    both = n.crossJoin(sums)  # three tables of one row
    gap = F.abs(F.col("_one.o") - F.col("_one.e") / F.col("_n"))
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), 2) * F.col("_n") * F.col("_ir") * F.col("_ic")
    plain = F.when(F.col("_n").isNotNull(), F.greatest(F.lit(0.0), F.col("_n") * F.col("_q") - F.col("_n")))
    x = F.when((F.col("_i") == 2) & (F.col("_j") == 2), corrected).otherwise(plain) if yates else plain
    small = F.least("_i", "_j") - 1
    dof = F.greatest(F.col("_i") - 1, F.lit(0)) * F.greatest(F.col("_j") - 1, F.lit(0))
    tail = F.pandas_udf(lambda v, d: pd.Series([None if pd.isna(a) else chi2_p(a, int(b)) for a, b in zip(v, d)], dtype="float64"), "double")
    out = both.withColumns({"x": x, "_dof": dof})
    return out.select(F.round("x", 4).alias("chi2"), F.col("_dof").cast("int").alias("dof"), F.coalesce(F.col("_n").cast("long"), F.lit(0)).alias("n"),
                      F.round(F.sqrt(F.try_divide("x", F.col("_n") * small)), 4).alias("cramers_v"), tail("x", F.col("_dof")).alias("p"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: tables no more likely than the one seen, same margins.

    Likelihoods rise to the mode and fall beyond it, so both tails are summed from where they
    start outwards, each term from the one before, until terms no longer count.
    """
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    log = lambda k: (math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1)
                     - math.lgamma(col - k + 1) - math.lgamma(n - row - col + k + 1) - math.lgamma(n + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1))
    up = lambda k: (row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1))  # noqa: E731  # term k + 1 by term k
    seen, mode = log(a) + 1e-7, min(high, max(low, (row + 1) * (col + 1) // (n + 2)))
    if log(mode) <= seen:
        return 1.0
    left, right = low - 1, mode  # the last place of the left tail, and the first before the right one
    top = mode
    while top - left > 1:
        mid = (left + top) // 2
        left, top = (mid, top) if log(mid) <= seen else (left, mid)
    end = high + 1
    while end - right > 1:
        mid = (right + end) // 2
        right, end = (mid, end) if log(mid) > seen else (right, mid)
    terms = []
    for k, step, ratio in ((left, -1, lambda k: 1 / up(k - 1)), (end, 1, up)):
        term = math.exp(log(k)) if low <= k <= high else 0.0
        first = term
        while term > first * 1e-18:
            terms.append(term)
            if not low <= k + step <= high:
                break
            term *= ratio(k)
            k += step
    return min(1.0, math.fsum(terms))


def fisher(df: DataFrame, row: str, column: str) -> DataFrame:
    """a, b, c, d and p over two boolean columns."""
    n = lambda x, y: F.count(F.when((F.col(row) == x) & (F.col(column) == y), 1))
    table = df.agg(n(True, True).alias("a"), n(True, False).alias("b"), n(False, True).alias("c"), n(False, False).alias("d"))
    p = F.pandas_udf(lambda a, b, c, d: pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64"), "double")
    return table.withColumn("p", p("a", "b", "c", "d"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average ranks from counts by value, so that no task has to sort all rows.

    Distinct values are range partitioned; offsets of partitions are one number each.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_k"))
    parts = saved(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()))
    before = F.sum("_k").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    parts = parts.withColumn("_b", before)
    sizes = parts.groupBy("_p").agg(F.sum("_k").alias("_n"))
    offset = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranked = parts.join(F.broadcast(offset), "_p").select(F.col(value).alias("_v"), (F.col("_o") + F.col("_b") + (F.col("_k") + 1) / 2.0).alias(out))
    return df.join(ranked, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, x, "_rx"), y, "_ry")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("_rx", "_ry"), 6).alias("rho"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, groups, n and p. H and p are null where they are
    not defined: all values equal, or no value at all."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("_t"))
    sums = average_ranks(rows, value, "_r").groupBy(F.col(group).alias("_g")).agg(F.sum("_r").alias("s"), F.count("*").alias("k"))
    h = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("k").alias("n"), F.count("*").alias("groups")).crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    untied = 1 - F.try_divide("_t", n * n * n - n)
    stat = F.try_divide(F.try_divide(12.0 * F.col("q"), n * (n + 1)) - 3 * (n + 1), untied)
    tail = F.pandas_udf(lambda x, g: pd.Series([None if pd.isna(a) else chi2_p(a, int(b) - 1) for a, b in zip(x, g)], dtype="float64"), "double")
    return h.withColumn("_h", stat).select(F.round("_h", 4).alias("h"), "groups", "n", tail("_h", F.col("groups")).alias("p"))


#: NumPy draws from populations smaller than this.
NUMPY_ROWS = 10**9


def hypergeometric(rng: np.random.Generator, left: int, right: int, labels: np.ndarray) -> np.ndarray:
    """How many of ``labels`` go left when they are dealt to left + right rows, for each entry.

    NumPy's own draw ends at 10^9 rows. Beyond, a ratio of uniforms (Stadlober, 1990) accepts
    values by their likelihood against the mode's, worked out from differences alone, so that
    nothing is lost to the size of the logarithms; where one cell is small, its labels are dealt
    one by one.
    """
    if left + right < NUMPY_ROWS:
        return rng.hypergeometric(left, right, labels)
    out = np.zeros(len(labels), np.int64)
    total = left + right
    for m in np.unique(labels):  # replicates mostly differ, so this is a loop over them
        at = np.flatnonzero(labels == m)
        mode = (int(m) + 1) * (left + 1) // (total + 2)
        cells = (mode, left - mode, int(m) - mode, right - int(m) + mode)
        if min(cells) < 1000:
            out[at] = _dealt(rng, left, right, int(m), len(at))
            continue
        sd = math.sqrt(m * (left / total) * (right / total) * ((total - m) / (total - 1)))
        tilt = math.log1p((cells[0] * cells[3] - cells[1] * cells[2]) / (cells[1] * cells[2]))
        wide, need = 1.7155277699214135 * math.sqrt(sd * sd + 0.5) + 0.8989161620588988, len(at)
        got: list[np.ndarray] = []
        while need > 0:
            u, v = rng.random(2 * need + 8), rng.random(2 * need + 8)
            shift = np.floor(0.5 + wide * (v - 0.5) / np.maximum(u, 1e-300))
            fits = (np.abs(shift) < min(cells)) & (np.abs(shift) < 40 * sd)
            x = np.where(fits, shift, 0.0)
            change = sum(_log_factorial_change(c, sign * x) for c, sign in zip(cells, (1, -1, -1, 1)))
            fine = x[fits & (2 * np.log(np.maximum(u, 1e-300)) <= -change - x * tilt)][:need]
            got.append(fine)
            need -= len(fine)
        out[at] = mode + np.concatenate(got).astype(np.int64)
    return out


def _log_factorial_change(n: int, by: np.ndarray) -> np.ndarray:
    """log (n + by)! - log n! - by log n, by Stirling's series, for a large n."""
    return (n + by + 0.5) * np.log1p(by / n) - by + 1 / (12 * (n + by)) - 1 / (12 * n)


def _dealt(rng: np.random.Generator, left: int, right: int, m: int, times: int) -> np.ndarray:
    """The smallest cell is filled one by one: either few labels, few rows on a side, or few rows without a label."""
    total = left + right
    if min(left, right) < min(m, total - m):  # labels and sides may change places
        return _dealt(rng, m, total - m, left, times) if left <= right else m - _dealt(rng, m, total - m, right, times)
    if m > total - m:
        return left - _dealt(rng, left, right, total - m, times)
    got = np.zeros(times, np.int64)
    for i in range(m):
        got += rng.random(times) * (total - i) < left - got
    return got


def _bucketed(df: DataFrame, person: str, size: int = 50_000) -> tuple[DataFrame, int]:
    """Rows by (person, bucket) with their number, and how often the number of buckets, with
    some ``size`` persons in each, halves."""
    each = saved(df.where(F.col(person).isNotNull()).groupBy(person).agg(F.count("*").alias("k"), F.count(F.when(F.col("_a"), 1)).alias("a")))
    halvings = max(4, (each.count() // size).bit_length())
    return each.withColumn("bucket", F.pmod(F.xxhash64(F.col(person)), F.lit(1 << halvings)).cast("int")), halvings


def _paths(each: DataFrame, halvings: int) -> DataFrame:
    """(bucket, level, here, left): for each bucket, level by level down a binary tree, the rows
    below the node on its way and below that node's left half."""
    leaf = F.col("bucket") + (1 << halvings)
    node = each.select("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(halvings)), lambda j: F.call_function("shiftright", leaf, j))).alias("node"))
    sizes = saved(node.groupBy("node").agg(F.sum("k").alias("rows")))
    way = each.select("bucket").distinct().select("bucket", F.explode(F.sequence(F.lit(0), F.lit(halvings - 1))).alias("level"))
    way = way.withColumn("node", F.call_function("shiftright", leaf, F.lit(halvings) - F.col("level")))
    half = sizes.select((F.col("node") / 2).cast("int").alias("node"), F.col("rows").alias("left"), (F.col("node") % 2).alias("odd")).where("odd = 0").drop("odd")
    return way.join(sizes.withColumnRenamed("rows", "here"), "node").join(half, "node", "left").select("bucket", "level", "node", "here", F.coalesce("left", F.lit(0)).alias("left"))


def overlap_permutation(df: DataFrame, person: str, series: str, a: str, b: str, times: int = 20_000, seed: int = 20240101) -> DataFrame:
    """Persons in both series against ``times`` shuffles of the series labels over rows:
    (observed, null_mean, null_sd, z, p_lower).

    Shuffled exactly, but bucket by bucket: the labels of ``a`` are split down a binary tree of
    buckets, at each node by a hypergeometric draw seeded by the node and the replicate. A task
    follows only the way to its own bucket, so what it holds grows with the tree's depth; tasks
    that pass the same node draw the same. Inside a bucket the labels fall on persons by the
    same law. A person counts with the number of their rows, so a busy person is one entry;
    those with one row can never be in both and are drawn as one. Without rows of either series
    the result is one row of zero and nulls; z is null where the shuffles do not vary.
    """
    rows = df.where(F.col(series).isin(a, b)).select(person, (F.col(series) == a).alias("_a"))
    each, halvings = _bucketed(rows, person)
    labels, block = int(each.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n")).first().n), 64

    def run(part: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        bucket, k = int(part["bucket"].iloc[0]), np.sort(part["k"].to_numpy(np.int64))
        own = np.concatenate(([np.int64((k == 1).sum())], k[k > 1]))
        most, out = own[1:], np.zeros(times, np.int64)
        nodes = way.sort_values("level")[["node", "here", "left"]].to_numpy(np.int64).tolist()
        for lo in range(0, times, block):
            share = np.full(min(block, times - lo), labels, np.int64)
            for level, (node, here, left) in enumerate(nodes):
                goes = hypergeometric(np.random.default_rng([seed, lo, node]), left, here - left, share)
                share = share - goes if bucket >> halvings - 1 - level & 1 else goes
            inside = np.random.default_rng([seed, lo, bucket + (1 << halvings)])
            for i, m in enumerate(share.tolist()):
                got = inside.multivariate_hypergeometric(own, m, method="marginals")[1:]
                out[lo + i] = ((got > 0) & (got < most)).sum()
        return pd.DataFrame({"replicate": np.arange(times), "overlap": out})

    ways = _paths(each, halvings).select(*[F.col(c).alias(c) for c in ("bucket", "level", "node", "here", "left")])
    many = 1 << min(halvings, 13)  # a bucket is much work for few rows: each to a task, never merged
    null = each.select("bucket", "k").repartition(many, "bucket").groupBy("bucket").cogroup(ways.repartition(many, "bucket").groupBy("bucket")).applyInPandas(run, "replicate int, overlap long").groupBy("replicate").agg(F.sum("overlap").alias("overlap"))
    seen = each.agg(F.count(F.when((F.col("a") > 0) & (F.col("a") < F.col("k")), 1)).alias("observed"))
    low = F.count(F.when(F.col("overlap") <= F.col("observed"), 1))
    mean, sd = F.avg("overlap"), F.stddev_samp("overlap")
    return null.crossJoin(F.broadcast(seen)).agg(F.coalesce(F.max("observed"), F.lit(0)).alias("observed"), mean.alias("null_mean"), sd.alias("null_sd"), F.when(sd > 0, (F.max("observed") - mean) / sd).alias("z"),
                                                 F.when(F.count("*") > 0, (low + 1) / F.lit(times + 1.0)).alias("p_lower"))  # seen is one row


def spread(df: DataFrame, cost: int, least: int = 50_000_000) -> DataFrame:
    """Rows of ``cost`` each, dealt by all columns to as many tasks as that makes, of ``least``
    or more: adaptive execution would put what is small but much work into one."""
    df = saved(df)
    many = -(-df.count() * max(1, cost) // least)
    return df.repartition(min(10_000, max(1, many)), *df.columns)


@cache
def _poisson_table(mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cumulative probabilities, and for each 16 leading bits of a uniform number the value, or
    -1 where the bits that follow decide."""
    k = np.arange(mean + 20 + int(20 * mean**0.5))
    log = np.array([i * math.log(mean) - mean - math.lgamma(i + 1) for i in k.tolist()])
    upto = np.cumsum(np.exp(log))
    at = np.searchsorted(upto, np.arange((1 << 16) + 1) / (1 << 16), side="right")
    clear = at[:-1] == np.searchsorted(upto, np.arange(1, (1 << 16) + 1) / (1 << 16), side="left")
    return upto, np.where(clear, at[:-1], -1).astype(np.int16), k


def poisson(bits: np.random.BitGenerator, mean: int, times: int) -> np.ndarray:
    """``times`` Poisson draws. For a small mean the cumulative probabilities are inverted: 16
    bits decide nearly always, else 53 more do; NumPy draws those of a large one."""
    if mean > 64:
        return np.random.Generator(bits).poisson(float(mean), times).astype(np.float64)
    upto, value, k = _poisson_table(mean)
    lead = bits.random_raw(-(-times // 4)).view(np.uint16)[:times]
    out = value.take(lead)
    open_ = np.flatnonzero(out < 0)
    if len(open_):
        u = (lead[open_] + np.random.Generator(bits).random(len(open_))) / (1 << 16)
        out[open_] = k[np.minimum(np.searchsorted(upto, u, side="right"), len(k) - 1)]
    return out.astype(np.float64)


def bootstrap_sums(df: DataFrame, group: str, value: str, times: int, seed: int = 1) -> DataFrame:
    """(g, replicate, w, s): weights and weighted sums of a Poisson bootstrap, by group.

    Equal values of a group are counted first: their Poisson(1) weights add up to one Poisson
    draw of that mean, so the cost follows distinct values, not rows. A value's draws come from
    a generator that group, value and ``seed`` fix, so replicates need no shared sample, do not
    depend on the partitions, and only sums by (group, replicate) are shuffled. A worker holds
    one value's draws at a time and the sums of the groups it has seen.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    each = rows.groupBy("g", "v").agg(F.count("*").alias("n")).select("g", "v", "n", F.xxhash64("g", "v").alias("k"))
    many = 256  # groups whose sums a worker keeps at once
    tasks = spread(each, times)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        bits = np.random.Philox(key=[seed, 0])
        fresh = bits.state

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"g": np.repeat(np.array(list(sums), object), times), "replicate": np.tile(np.arange(times), len(sums)),
                                 "w": np.concatenate([x[0] for x in sums.values()]), "s": np.concatenate([x[1] for x in sums.values()])})
            sums.clear()
            return made

        for part in parts:
            for g, v, n, k in part.itertuples(index=False):
                fresh["state"]["key"][1] = k & 0xFFFFFFFFFFFFFFFF
                bits.state = fresh  # as a new generator with this key, which takes longer to make
                w = poisson(bits, int(n), times)
                if g not in sums and len(sums) == many:
                    yield out()
                held = sums.setdefault(g, np.zeros((2, times)))
                held[0] += w
                held[1] += v * w
        if sums:
            yield out()

    kind = df.schema[group].dataType.simpleString()
    return tasks.mapInPandas(run, f"g {kind}, replicate int, w double, s double").groupBy("g", "replicate").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).where("w > 0")


def bootstrap_mean(df: DataFrame, group: str, value: str, times: int = 10_000, seed: int = 1) -> DataFrame:
    """(group, n, mean, lo, hi): percentile interval of each group's mean. Rows without a
    value or a group are left out."""
    ci = bootstrap_sums(df, group, value, times, seed).groupBy(F.col("g").alias("_g")).agg(F.expr("percentile(s / w, array(0.025, 0.975))").alias("ci"))
    means = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return means.join(ci, F.col(group) == F.col("_g")).select(group, "n", "mean", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))


def bootstrap_difference(df: DataFrame, group: str, value: str, a: object, b: object, times: int = 10_000, seed: int = 1) -> DataFrame:
    """(difference, lo, hi, p): mean of group ``a`` less that of ``b``, its percentile interval
    and the two-sided p, twice the smaller share of replicates on either side of zero, at most
    1. Nulls where a group has no rows."""
    two = df.where(F.col(group).isin(a, b))
    mean = lambda x: F.sum(F.when(F.col("g") == x, F.col("s") / F.col("w")))
    each = bootstrap_sums(two, group, value, times, seed).groupBy("replicate").agg((mean(a) - mean(b)).alias("d")).where("d is not null")
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    found = each.agg(F.expr("percentile(d, array(0.025, 0.975))").alias("ci"), p.alias("p"))
    seen = two.agg((F.avg(F.when(F.col(group) == a, F.col(value))) - F.avg(F.when(F.col(group) == b, F.col(value)))).alias("difference"))
    return seen.crossJoin(F.broadcast(found)).select("difference", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"), "p")  # one row each


def kaplan_meier(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """(group, time, at risk, events, survival, Greenwood standard error).

    Counts by (group, time) come first, so windows see distinct times, not persons. The
    running product is the exponential of a running sum of logarithms, and 0 from the first
    factor of 0 on. ``_survival`` is the product before rounding.
    """
    t = df.groupBy(group, time).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count("*").alias("k"))
    w = Window.partitionBy(group).orderBy(time)
    t = t.withColumn("at_risk", F.sum("k").over(Window.partitionBy(group).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("at_risk") - F.col("d")
    logs = F.sum(F.when(left > 0, F.log(left / F.col("at_risk")))).over(run)
    t = t.withColumn("s", F.when(F.max(left == 0).over(run), 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0)))))
    var = F.sum(F.when(left > 0, F.col("d") / (F.col("at_risk") * left)).otherwise(0.0)).over(run)
    out = t.withColumn("_v", var).where("d > 0")
    return out.select(group, time, "at_risk", F.col("d").alias("events"), F.round("s", 6).alias("survival"), F.round(F.col("s") * F.sqrt("_v"), 6).alias("se"), F.col("s").alias("_survival"))


def median_survival(km: DataFrame, group: str, time: str) -> DataFrame:
    """First time at which survival is at most one half, judged before rounding (to a part in
    10^12, for a product of many factors); null if it never is."""
    return km.groupBy(group).agg(F.min(F.when(F.col("_survival") <= 0.5 + 1e-12, F.col(time))).alias("median_time"))


def logrank(df: DataFrame, group: str, a: str, time: str, event: str) -> DataFrame:
    """Log-rank chi-square of group ``a`` against the rest, with observed and expected events
    and p. chi2 and p are null where the variance is 0, such as with all events at the last
    time; without an event observed and expected are null, too.

    Numbers at risk are running sums over distinct times: partitions by range, and an offset
    for each, so that no task sees all times."""
    t = df.withColumn("_a", F.col(group) == a).groupBy(time).agg(
        F.count(F.when(F.col("_a"), 1)).alias("ka"), F.count("*").alias("k"), F.sum(F.when(F.col("_a"), F.col(event).cast("int")).otherwise(0)).alias("da"), F.sum(F.col(event).cast("int")).alias("d"))
    t = _still_there(t, time).where("d > 0")
    e = F.col("d") * F.col("na") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * F.col("na") / F.col("n") * (1 - F.col("na") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = t.agg(F.sum("da").alias("o"), F.sum(e).alias("e"), F.sum(v).alias("v"))
    s = s.withColumn("x", F.try_divide((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")), F.when(F.col("v") > 1e-12, F.col("v"))))
    return s.select(F.col("o").alias("observed"), F.round("e", 4).alias("expected"), F.round("x", 4).alias("chi2"), _one_dof("x").alias("p"))


def _still_there(t: DataFrame, time: str) -> DataFrame:
    """``n`` and ``na``: sums of ``k`` and ``ka`` at this and all later times."""
    parts = saved(t.repartitionByRange(F.col(time).desc()).withColumn("_p", F.spark_partition_id()))
    down = Window.partitionBy("_p").orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = parts.groupBy("_p").agg(F.sum("k").alias("_k"), F.sum("ka").alias("_ka"))
    offset = sizes.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_k", "_ka")])
    inside = parts.withColumns({"n": F.sum("k").over(down), "na": F.sum("ka").over(down)})
    return inside.join(F.broadcast(offset), "_p").withColumns({"n": F.col("n") + F.col("_k"), "na": F.col("na") + F.col("_ka")}).drop("_p", "_k", "_ka")


def _one_dof(x: str) -> Column:
    tail = F.pandas_udf(lambda v: pd.Series([None if pd.isna(a) else chi2_p(a, 1) for a in v], dtype="float64"), "double")
    return tail(x)


def mantel_haenszel(df: DataFrame, stratum: str, exposed: str, outcome: str, correction: float = 0.5) -> DataFrame:
    """Cochran-Mantel-Haenszel chi-square with continuity correction and pooled odds ratio
    over 2 x 2 tables, one a stratum, and p. chi2 and p are null where no stratum has both
    kinds of exposure and of outcome, the odds ratio where its denominator is 0."""
    n = lambda x, y: F.count(F.when((F.col(exposed) == x) & (F.col(outcome) == y), 1)).cast("double")
    t = df.groupBy(F.col(stratum).alias("_s")).agg(n(True, True).alias("a"), n(True, False).alias("b"), n(False, True).alias("c"), n(False, False).alias("d"))
    t = t.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d")).where("n > 1")
    e = (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / F.col("n")
    v = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    s = t.agg(F.count("*").alias("strata"), F.sum(F.col("a") - e).alias("g"), F.sum(v).alias("v"), F.sum(F.col("a") * F.col("d") / F.col("n")).alias("r"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("q"))
    gap = F.greatest(F.lit(0.0), F.abs("g") - correction)
    s = s.withColumn("x", F.try_divide(gap * gap, "v"))
    return s.select("strata", F.round("x", 4).alias("chi2"), F.round(F.try_divide("r", "q"), 4).alias("odds_ratio"), _one_dof("x").alias("p"))
