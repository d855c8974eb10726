"""Pairs of groups: what a task holds, and what is shuffled, does not grow with the table."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import graph, joins
from rollcall.plans.all import QUERIES
from tests.conftest import SMALL


def brute(rows):
    out = {}
    for g, a in set(rows):
        for h, b in set(rows):
            if g == h and a < b:
                out[a, b] = out.get((a, b), 0) + 1
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("block", [7, 2000])
def test_dense_groups_meet_in_blocks(spark, block, kind):
    r = random.Random(4)
    rows = [(r.randrange(6), r.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame(rows + [(None, 1), (2, None)], "g int, p long").withColumn("p", F.col("p").cast(kind))
    got = graph.co_presence(df, "g", "p", block=block)
    cast = str if kind == "string" else int
    assert {(x.a, x.b): x.weight for x in got.collect()} == brute([(g, cast(p)) for g, p in rows])
    assert "sum(" not in got._jdf.queryExecution().optimizedPlan().toString()  # a pair is one row, never summed by key


def test_tasks_follow_the_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 50)
    rows = [(g, 3 * g + i) for g in range(200) for i in range(4)]
    got = graph.co_presence(spark.createDataFrame(rows, "g int, p int"), "g", "p")
    each = got.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    assert len(each) >= 12 and max(x["count"] for x in each) < 150  # 1200 pairs over 24 tasks
    assert {(x.a, x.b): x.weight for x in got.collect()} == brute(rows)


def test_betweenness_of_a_dense_graph_is_quick(spark):
    import time

    import numpy as np

    n = 200
    first = np.arange(0, n * (n - 1) + 1, n - 1)
    target = np.concatenate([np.delete(np.arange(n), v) for v in range(n)])
    start = time.perf_counter()
    assert all(not graph._dependencies(s, n, first, target).any() for s in range(20))  # no one stands between
    assert time.perf_counter() - start < 5
    line = np.array([1, 0, 2, 1, 3, 2])
    assert graph._dependencies(0, 4, np.array([0, 1, 3, 5, 6]), line).tolist() == [0, 2, 1, 0]


def test_related_items_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_SUMS", 40)
    r = random.Random(6)
    rows = list({(r.randrange(30), f, 1 + f % 3) for f in [0] * 25 + [r.randrange(20) for _ in range(150)]})
    got = {(x.item, x.other, x.score, x["rank"]) for x in joins.related(spark.createDataFrame(rows, "item int, feature int, w int"), "item", "feature", "w", 4).collect()}
    score = {}
    for a, f, w in rows:
        for b, g, _ in rows:
            if f == g and a != b:
                score[a, b] = score.get((a, b), 0) + w
    want = {(a, -s, b) for (a, b), s in score.items()}
    assert got == {(a, b, -s, i + 1) for a in range(30) for i, (_, s, b) in enumerate(sorted(x for x in want if x[0] == a)[:4])}


@pytest.mark.parametrize("name", ["f01_nfkc", "s02_html_text"])
def test_texts_go_to_python_in_small_batches(spark, name):
    sizes = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for x in sizes:
        spark.conf.unset(x)
    QUERIES[name](spark, SMALL)
    assert [spark.conf.get(x) for x in sizes] == ["512", "8m"]


def straight(pairs):
    """Brandes by plain loops, unscaled."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        away, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in away:
                    away[w], paths[w] = away[v] + 1, 0.0
                    order.append(w)
                if away[w] == away[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if away[v] == away[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    scale = (len(near) - 1) * (len(near) - 2)
    return {v: round(x / scale, 8) for v, x in total.items()}


@pytest.mark.parametrize("kind,limit,at_once", [("long", 1000, 1e11), ("string", 1000, 0), ("long", 60, 0)])
def test_betweenness_by_components(spark, kind, limit, at_once):
    r = random.Random(8)
    rows = [(r.randrange(30), r.randrange(30)) for _ in range(90)] + [(i, i + 1) for i in range(100, 118)] + [(200, 201), (300, 300)]
    edges = spark.createDataFrame(rows, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
    got = {x.node: x.betweenness for x in graph.betweenness(edges, limit, 7, at_once).collect()}
    want = straight(rows)
    assert got.keys() == {str(v) if kind == "string" else v for v in want} and all(abs(got[str(v) if kind == "string" else v] - x) < 2e-8 for v, x in want.items())


def test_many_components_are_more_than_the_limit(spark, monkeypatch):
    rows = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(5) for j in range(i)]
    monkeypatch.setattr(graph, "_searched_by_joins", None)  # each component is under the limit
    assert {x.betweenness for x in graph.betweenness(spark.createDataFrame(rows, "a long, b long"), 12).collect()} == {0.0}


def test_blocks_of_persons_are_not_repeated_for_each_other_block(spark):
    def shuffled():
        each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    sent = []
    for n in (200, 800):
        rows = spark.range(n * 4).selectExpr(f"id div {n} as g", f"id % {n} as p")
        before = shuffled()
        graph.co_presence(rows, "g", "p", block=4).write.format("noop").mode("overwrite").save()  # 50 and 200 blocks
        sent.append(shuffled() - before)
    assert sent[1] < 8 * sent[0]  # 16 times as many pairs of blocks


@pytest.mark.parametrize("kind,block", [("int", 1000), ("int", 20), ("string", 20)])
def test_related_items_in_blocks(spark, kind, block):
    r = random.Random(6)
    rows = list({(r.randrange(30), f, 1 + f % 3) for f in [0] * 25 + [r.randrange(20) for _ in range(150)]})
    df = spark.createDataFrame(rows + rows[:9] + [(None, 1, 1), (4, None, 1)], "item int, feature int, w int").withColumn("item", F.col("item").cast(kind))
    found = joins.related(df, "item", "feature", "w", 4, block)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "mapinarrow" in plan and "sum(" not in plan  # no pair is shuffled
    cast = str if kind == "string" else int
    score = {}
    for a, f, w in rows:
        for b, g, _ in rows:
            if f == g and a != b:
                score[cast(a), cast(b)] = score.get((cast(a), cast(b)), 0) + w
    want = {(a, b, -s, i + 1) for x in {a for a, _ in score} for i, (s, b, a) in enumerate(sorted((-s, b, a) for (a, b), s in score.items() if a == x)[:4])}
    assert {(x.item, x.other, x.score, x["rank"]) for x in found.collect()} == want
    assert joins.related(df.limit(0), "item", "feature", "w", 4).count() == 0
