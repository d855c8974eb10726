"""First span at a point, against all pairs; without a key and with one hot key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import joins


def first_span(spans, key, at):
    fit = [(o, v, s, e) for k, s, e, v, o in spans if k == key and (s is None or s <= at) and (e is None or at <= e)]
    return min(fit, key=lambda x: x[:2])[1] if fit else None


def many(seed, keys, day=None):
    r = random.Random(seed)
    move = day or (lambda x: x)
    spans = []
    for i in range(400):
        a, long = r.randrange(-500, 3000), r.choice([0, 1, 5, 60, 3000])
        spans.append((r.choice(keys), None if i % 17 == 0 else move(a), None if i % 13 == 0 else move(a + r.randrange(-2, long + 1)), f"v{i:03}", r.randrange(60)))
    rows = [(i, None if i % 50 == 0 else r.choice(keys), None if i % 41 == 0 else move(r.randrange(0, 2600))) for i in range(600)]
    return spans, rows


@pytest.mark.parametrize("keys", [["hot"], ["hot"] * 9 + ["a", "b"]])
def test_equals_all_pairs(spark, keys):
    spans, rows = many(len(keys), keys)
    s = spark.createDataFrame(spans, "k string, start long, end long, v string, o int")
    df = spark.createDataFrame(rows, "id int, k string, at long")
    got = {x.id: (x.v, x.span_start, x.span_end) for x in joins.valid_at(df, s, "k", "at", "v", "o").collect()}
    assert len(got) == len(rows)
    ends = {v: (a, b) for _, a, b, v, _ in spans}
    for i, k, at in rows:
        want = first_span(spans, k, at) if k and at is not None else None
        assert got[i] == ((want, *ends[want]) if want else (None, None, None))


def test_dates_and_times_without_a_key(spark):
    base = datetime.date(2000, 1, 1)
    spans, rows = many(5, ["x"], lambda n: base + datetime.timedelta(days=n))
    s = spark.createDataFrame(spans, "k string, start date, end date, v string, o int")
    df = spark.createDataFrame(rows, "id int, k string, at date")
    want = {i: first_span(spans, "x", at) if at else None for i, _, at in rows}
    assert {x.id: x.v for x in joins.valid_at(df, s, None, "at", "v", "o").collect()} == want
    times = lambda d, *c: d.withColumns({x: F.col(x).cast("timestamp") for x in c})
    assert {x.id: x.v for x in joins.valid_at(times(df, "at"), times(s, "start", "end"), None, "at", "v", "o").collect()} == want


def test_no_rows_on_a_side(spark):
    s = spark.createDataFrame([("k", 1, 2, "v", 0)], "k string, start long, end long, v string, o int")
    df = spark.createDataFrame([(1, "k", 2)], "id int, k string, at long")
    assert joins.valid_at(df.limit(0), s, "k", "at", "v", "o").count() == 0
    assert [x.v for x in joins.valid_at(df, s.limit(0), "k", "at", "v", "o").collect()] == [None]
    assert [x.v for x in joins.valid_at(df, s, "k", "at", "v", "o").collect()] == ["v"]


def test_joined_rows_do_not_grow_with_pairs(spark):
    """2,000 spans that all hold all 2,000 points are one bin."""
    s = spark.range(2000).selectExpr("'k' as k", "cast(null as long) as start", "cast(null as long) as end", "concat('v', id) as v", "id as o")
    df = spark.range(2000).selectExpr("'k' as k", "id as at")
    cover = s.select(F.explode(joins._cover(F.lit(0), F.lit(1999), 11)).alias("b")).select("b.*").distinct().count()
    assert cover <= 22
    assert {x.v for x in joins.valid_at(df, s, "k", "at", "v", "o").collect()} == {"v0"}
