"""Entries are found by content, appear whole or not at all, and go when told."""

import os

import pytest
from pyspark.sql import functions as F

from rollcall.store import Store, content_hash


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(spark, n=5, more=()):
    return spark.createDataFrame([(i, f"t{i}", float(i)) for i in range(n)] + list(more), "id long, text string, x double")


def test_second_run_reads(spark, store):
    made = []

    def total(docs, least):
        made.append(least)
        return docs.where(F.col("x") >= least).agg(F.count("*").alias("n"), F.sum("x").alias("s"))

    first = store.get("total", {"docs": rows(spark)}, total, {"least": 2})
    again = store.get("total", {"docs": rows(spark).repartition(3).orderBy(F.desc("id"))}, total, {"least": 2})
    assert made == [2] and [tuple(r) for r in first.collect()] == [tuple(r) for r in again.collect()] == [(3, 9.0)]
    store.get("total", {"docs": rows(spark)}, total, {"least": 3})
    store.get("total", {"docs": rows(spark, 5, [(5, None, None)])}, total, {"least": 2})
    store.get("total", {"docs": rows(spark).withColumn("x", F.when(F.col("id") != 4, F.col("x")).otherwise(4.5))}, total, {"least": 2})
    store.get("total", {"docs": rows(spark)}, total, {"least": 2}, version="2")
    assert made == [2, 3, 2, 2, 2] and len(store.entries()) == 5
    assert {e[0] for e in store.entries()} == {"total"} and store.forget("total", keep=2) == 3 and len(store.entries()) == 2
    store.get("total", {"docs": rows(spark)}, total, {"least": 2}, version="2")
    assert len(made) == 5 and store.forget("total") == 2 and store.forget("nothing") == 0


def test_a_failed_run_leaves_nothing(spark, store):
    def bad(docs):
        return docs.select(F.raise_error(F.lit("no")).alias("x"))

    with pytest.raises(Exception, match="no"):
        store.get("bad", {"docs": rows(spark)}, bad)
    assert not [e for e in store.entries() if e[0] == "bad"]
    assert store.get("bad", {"docs": rows(spark)}, lambda docs: docs.select("id")).count() == 5


def test_of_two_writers_one_wins(spark, store):
    key = store.key({"docs": rows(spark)})
    assert store.publish("same", key, rows(spark)) and not store.publish("same", key, rows(spark))
    assert store.read("same", key).count() == 5 and os.listdir(f"{store.root}/_work") == []
    assert not [x for x in os.listdir(f"{store.root}/same/{key}") if os.path.isdir(f"{store.root}/same/{key}/{x}")]


def test_hash_tells_rows_apart(spark):
    one = lambda *r: content_hash(spark.createDataFrame(r, "a string, b string, m map<string, int>"))
    seen = [one((None, "x", {})), one(("x", None, {})), one(("x", "x", None)), one(("x", None, {}), ("x", None, {})), one(("", "x", {})), one(("x", None, {"k": 1})), one()]
    assert len(set(seen)) == len(seen)
    assert one(("a", "b", None), ("c", "d", None)) == one(("c", "d", None), ("a", "b", None))
    assert content_hash(spark.range(3)) != content_hash(spark.range(3).withColumnRenamed("id", "k"))
