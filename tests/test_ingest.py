"""A stream that is cut short, replayed or started again feeds each batch once."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from rollcall.store import Store
from rollcall.streaming.ingest import Ledger


@pytest.fixture
def feed(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "tables")), tmp_path / "in"
    folder.mkdir()

    def put(name, *rows):
        (folder / f"{name}.json").write_text(json.dumps([dict(zip(("id", "v", "n"), r)) for r in rows]))

    def run(ledger, source="s"):
        stream = spark.readStream.schema("id long, v string, n int").option("multiLine", True).option("maxFilesPerTrigger", 1).json(str(folder))
        q = ledger.upsert(stream, source, str(tmp_path / f"checkpoint-{source}"))
        q.awaitTermination()
        assert q.exception() is None

    return store, put, run, tmp_path


def uncommit(checkpoint):
    """As if the driver was lost after the last batch, before its commit."""
    last = max(checkpoint.glob("commits/[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def rows(ledger):
    return sorted(tuple(r) for r in ledger.current().select("id", "v", "n").collect())


def test_later_rows_replace(feed):
    store, put, run, _ = feed
    table = Ledger(store, "t", ["id"], "n")
    with pytest.raises(ValueError):
        table.current()
    put("a", (1, "old", 1), (1, "new", 2), (2, "two", 1), (1, "mid", 1))
    run(table)
    assert rows(table) == [(1, "new", 2), (2, "two", 1)]
    put("b", (2, "again", 5), (3, None, None))
    run(table)
    run(table)
    assert rows(table) == [(1, "new", 2), (2, "again", 5), (3, None, None)] and len(table.noted()) == 2


def test_known_keys_stay(feed):
    store, put, run, _ = feed
    table = Ledger(store, "t", ["id"], replace=False)
    put("a", (1, "first", 1))
    run(table)
    put("b", (1, "second", 2), (2, "x", 3))
    run(table)
    assert rows(table) == [(1, "first", 1), (2, "x", 3)]


def test_a_batch_that_runs_again_is_left_alone(feed, spark):
    store, put, run, folder = feed
    table = Ledger(store, "t", ["id"])
    put("a", (1, "one", 1))
    put("b", (2, "two", 2))
    run(table)
    uncommit(folder / "checkpoint-s")
    before = table.noted()
    run(table)
    assert table.noted() == before and rows(table) == [(1, "one", 1), (2, "two", 2)]
    shutil.rmtree(folder / "checkpoint-s")  # a stream that starts anew, under a new name
    run(table, "again")
    assert len(table.noted()) == len(before) * 2 and rows(table) == [(1, "one", 1), (2, "two", 2)]


def test_a_batch_that_fails_leaves_nothing(feed, spark):
    store, _, _, _ = feed
    table = Ledger(store, "t", ["id"])
    bad = spark.range(3).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table._write(bad, 0, "s")
    assert table.noted() == []
    table._write(spark.range(3).withColumn("v", F.lit("x")), 0, "s")
    table._write(spark.range(9).withColumn("v", F.lit("y")), 0, "s")
    assert table.current().count() == 3


def test_compaction_keeps_rows_and_ledger(feed):
    store, put, run, folder = feed
    table = Ledger(store, "t", ["id"])
    for name, *r in (("a", (1, "one", 1)), ("b", (2, "two", 2)), ("c", (1, "uno", 3))):
        put(name, *r)
        run(table)
    before = rows(table)
    table.compact()
    assert rows(table) == before == [(1, "uno", 3), (2, "two", 2)]
    uncommit(folder / "checkpoint-s")
    run(table)
    put("d", (2, "dos", 4))
    run(table)
    assert rows(table) == [(1, "uno", 3), (2, "dos", 4)]
