"""Best candidates by rules against the plain join of a block."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import joins

SAME, NEAR = {("seg", "tseg"): 60, ("kind", "tkind"): 20}, ("bal", "tbal", 5.0, 30)


def sides(spark, n, blocks, seed=5):
    r = random.Random(seed)

    def rows(first):
        return [(first + i, r.choice([*range(blocks), None]), r.choice("abc") if r.random() < 0.95 else None, r.choice([1, 2, None]),
                 r.choice([None, float("nan"), 5.0, -5.0, 0.0, 10.0, *[round(r.uniform(-30, 30), 1) for _ in range(30)]])) for i in range(n)]

    names = "aid long, block int, seg string, kind int, bal double", "tid long, block int, tseg string, tkind int, tbal double"
    return spark.createDataFrame(rows(0), names[0]), spark.createDataFrame(rows(1000), names[1])


def plain(a, t, n):
    near = F.abs(F.col("bal") - F.col("tbal")) < 5.0
    score = F.when(F.col("seg") == F.col("tseg"), 60).otherwise(0) + F.when(F.col("kind") == F.col("tkind"), 20).otherwise(0) + F.when(near, 30).otherwise(0)
    return joins.candidates(a, t, "block", "aid", "tid", score, n)


def rows(df):
    return sorted(tuple(x) for x in df.select("aid", "tid", "score", "rank", "ambiguous").collect())


@pytest.mark.parametrize("n,levels", [(1, 2), (5, 3), (3, 10)])
def test_same_rows_as_all_pairs_of_a_block(spark, n, levels):
    a, t = sides(spark, 120, 2)
    got = rows(joins.rule_candidates(a, t, "block", "aid", "tid", SAME, NEAR, n, levels))
    assert got == rows(plain(a, t, n)) and len(got) > 100 * n * 0.6


def test_no_rows(spark):
    a, t = sides(spark, 20, 1)
    for x, y in ((a.limit(0), t), (a, t.limit(0))):
        assert rows(joins.rule_candidates(x, y, "block", "aid", "tid", SAME, NEAR)) == []


def test_pairs_do_not_grow_with_the_block(spark):
    """One block: three times the targets of as many values, and hardly more pairs an alias."""
    a, t = sides(spark, 60, 1, 7)
    more = t.unionByName(t.withColumn("tid", F.col("tid") + 1000)).unionByName(t.withColumn("tid", F.col("tid") + 2000))
    each = [joins.rule_pairs(a, x, "block", "aid", "tid", {("seg", "tseg"): 60}, NEAR, 1, 4).count() for x in (t, more, more.unionByName(more.withColumn("tid", F.col("tid") + 3000)))]
    assert each[2] <= 1.1 * each[1] <= 2.2 * each[0]


def test_tasks_by_the_number_of_rows(spark, monkeypatch):
    """A side that comes in one piece is dealt: no task cuts all its rows into bins."""
    monkeypatch.setattr(joins, "TASK_TARGETS", 10)
    a, t = sides(spark, 95, 2)
    assert joins._dealt(t.coalesce(1), "tid").rdd.getNumPartitions() == 10
    assert rows(joins.rule_candidates(a.coalesce(1), t.coalesce(1), "block", "aid", "tid", SAME, NEAR, 2, 3)) == rows(plain(a, t, 2))
