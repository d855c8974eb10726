"""Draws by their law, trees of draws, tails by terms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import stats


def log_choose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


@pytest.mark.parametrize(("left", "right", "m"), [(4000, 4000, 4000), (9000, 5000, 3500), (3000, 40000, 30000), (20, 900, 400), (900, 20, 400), (500, 400, 10), (500, 400, 890)])
def test_large_draws_follow_the_law(monkeypatch, left, right, m):
    monkeypatch.setattr(stats, "NUMPY_ROWS", 0)
    n = 20_000
    got = np.bincount(stats.hypergeometric(np.random.default_rng(5), left, right, np.full(n, m)))
    want = {k: n * math.exp(log_choose(left, k) + log_choose(right, m - k) - log_choose(left + right, m)) for k in range(max(0, m - right), min(left, m) + 1)}
    cells = [k for k, e in want.items() if e >= 8]
    chi2 = sum((got[k] - want[k]) ** 2 / want[k] for k in cells if k < len(got)) if cells else 0
    assert got.sum() == n and stats.gamma_tail((len(cells) - 1) / 2, chi2 / 2) > 1e-4


def test_draws_beyond_numpy():
    left, right, m = 3 * 10**11, 7 * 10**11, 2 * 10**11
    x = stats.hypergeometric(np.random.default_rng(1), left, right, np.full(4000, m)) - 0.3 * m
    sd = math.sqrt(m * 0.3 * 0.7 * (1 - m / (left + right)))
    assert abs(x.mean()) < 5 * sd / math.sqrt(4000) and abs(x.std() / sd - 1) < 0.06
    assert stats.hypergeometric(np.random.default_rng(1), 0, 2 * 10**9, np.array([5, 7])).tolist() == [0, 0]


def test_paths_add_up(spark):
    each = spark.createDataFrame([(p, 1 + p % 3) for p in range(500)], "p long, k long").withColumn("bucket", F.pmod(F.xxhash64("p"), F.lit(16)).cast("int"))
    size = {r.bucket: r.n for r in each.groupBy("bucket").agg(F.sum("k").alias("n")).collect()}
    rows = stats._paths(each, 4).collect()
    assert len(rows) == 4 * len(size)
    for r in rows:
        below = [size.get(b, 0) for b in range(16) if (b + 16) >> (4 - r.level) == r.node]
        assert r.here == sum(below) and r.left == sum(below[: len(below) // 2])


def test_z_and_many_buckets(spark, monkeypatch):
    r = random.Random(2)
    rows = [(p, "A" if r.random() < 0.4 else "B") for p in range(300) for _ in range(1 + p % 3)]
    df = spark.createDataFrame(rows, "p long, s string")
    one = stats.overlap_permutation(df, "p", "s", "A", "B", 3000).first()
    monkeypatch.setattr(stats, "_bucketed", lambda d, p, f=stats._bucketed: f(d, p, 5))
    two = stats.overlap_permutation(df, "p", "s", "A", "B", 3000).first()
    assert one.z == pytest.approx((one.observed - one.null_mean) / one.null_sd) and abs(one.null_mean - two.null_mean) < 0.6 and abs(one.null_sd - two.null_sd) < 0.5
    assert stats.overlap_permutation(df.where("s = 'A'"), "p", "s", "A", "B", 20).first().z is None


def test_bootstrap_of_counted_values(spark):
    rows = [("x", float(i % 4)) for i in range(4000)]
    got = stats.bootstrap_mean(spark.createDataFrame(rows, "g string, v double"), "g", "v", 2000).first()
    se = math.sqrt(1.25 / 4000)
    assert got.n == 4000 and got.lo == pytest.approx(1.5 - 1.96 * se, abs=0.006) and got.hi == pytest.approx(1.5 + 1.96 * se, abs=0.006)


@pytest.mark.parametrize("table", [(3, 1, 1, 3), (0, 5, 7, 2), (12, 5, 29, 2), (10, 0, 0, 10), (0, 0, 0, 0), (1, 0, 0, 0), (50, 60, 70, 80), (2, 800, 9, 700)])
def test_fisher_equals_all_tables(table):
    a, b, c, d = table
    n, row, col = sum(table), a + b, a + c
    log = {k: log_choose(row, k) + log_choose(n - row, col - k) - log_choose(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)}
    want = min(1.0, math.fsum(math.exp(x) for x in log.values() if x <= log[a] + 1e-7))
    assert stats.fisher_exact(*table) == pytest.approx(want, rel=1e-9)


def test_fisher_of_a_large_table_is_quick():
    assert stats.fisher_exact(10**9, 10**9 + 50_000, 10**9 + 20_000, 10**9) == pytest.approx(0.2684, abs=2e-3)


@pytest.mark.parametrize("mean", [1, 3, 60, 200])
def test_poisson_draws_follow_the_law(mean):
    n = 200_000
    got = np.bincount(stats.poisson(np.random.Philox(key=np.array([3, 2**64 - 5], np.uint64)), mean, n).astype(int), minlength=mean * 3)
    want = [n * math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(len(got))]
    cells = [k for k, e in enumerate(want) if e >= 8]
    chi2 = sum((got[k] - want[k]) ** 2 / want[k] for k in cells)
    assert got.sum() == n and stats.gamma_tail((len(cells) - 1) / 2, chi2 / 2) > 1e-4


def test_much_work_on_few_rows_is_dealt(spark):
    df = spark.range(400).withColumn("v", F.col("id") * 0.5)
    dealt = stats.spread(df, 10, 100)
    assert len({r.p for r in dealt.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 20
    assert dealt.count() == 400
