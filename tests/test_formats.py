import sqlite3

import pytest

from rollcall.operators import graph
from rollcall.sources.formats import register_formats


@pytest.fixture
def load(spark, tmp_path):
    register_formats(spark)

    def run(name, schema, files, **options):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        for k, v in files.items():
            (folder / k).write_bytes(v if isinstance(v, bytes) else v.encode())
        return spark.read.format(name).schema(schema).options(**options).load(str(folder))

    return run


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_markdown(load):
    text = "# x\n\n### a b\nwords\n```csv\nid,name,x\n1,\"A, \"\"q\"\"\",2.5\n2,B\n\n```\n### other\n```csv\nid\n9\n```\n### a b\r\n```csv\r\nname,id\r\n\"two\nlines\",3\r\n```\n### empty\nno block\n"
    df = load("markdown_csv", "id long, name string, x double, gone string", {"1.md": text, "2.md": "no table", "_x": text, ".y": text, "3.md": ""}, block="a b")
    assert told(df) == [(1, 'A, "q"', 2.5, None), (2, "B", None, None), (3, "two\nlines", None, None)]
    assert df.rdd.getNumPartitions() == 2


def test_fenced_lines(load):
    text = 'x\n{"id": 0}\n```jsonl\n// no\n{"id": 1, "v": {"a": [1]}}\n{bad\n[1]\n\n```\n```\n{"id": 5}\n```\n```json\n{"id": "7", "ok": true, "v": "é"}\n```\n'
    assert told(load("fenced_jsonl", "id long, v string, ok boolean, _bad string", {"a": "﻿" + text})) == [(1, '{"a": [1]}', None, None), (7, "é", True, None), (None, None, None, "[1]"), (None, None, None, "{bad")]


def test_wrapped(load):
    text = 'const A = [{"id": 1, "s": "x;\\n"}, {"id": "no"}];\nlet B={"id": 2};\nvar C = [];\n// end'
    assert told(load("wrapped_json", "id int, s string", {"a.js": text})) == [(1, "x;\n"), (2, None), (None, None)]


def test_sqlite_reads_asked_columns(load, tmp_path):
    for i in range(3):
        db = sqlite3.connect(tmp_path / f"{i}.db")
        db.execute('create table "my t" (id integer, big blob, name text)')
        db.executemany('insert into "my t" values (?, zeroblob(10), ?)', [(10 * i + j, f"n{j}") for j in range(i)])
        db.commit()
        db.close()
    files = {f"{i}.db": (tmp_path / f"{i}.db").read_bytes() for i in range(3)}
    assert told(load("sqlite", "name string, id long, other string", files, table="my t")) == [("n0", 10, None), ("n0", 20, None), ("n1", 21, None)]


def test_no_schema_and_no_file(spark, load, tmp_path):
    register_formats(spark)
    with pytest.raises(Exception, match="needs a schema"):
        spark.read.format("sqlite").load(str(tmp_path))
    with pytest.raises(Exception, match="nothing-here"):
        spark.read.format("sqlite").schema("a int").load(f"{tmp_path}/nothing-here").collect()


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_of_a_hot_group(spark, block):
    rows = [("hot", p, p % 3) for p in range(40)] * 2 + [("b", 1, 0), ("b", 2, 0), ("c", 5, 0), ("d", None, 0)]
    df = spark.createDataFrame(rows, "g string, p int, item int")
    got = {(x.a, x.b): x.weight for x in graph.co_presence(df, "g", "p", block=block).collect()}
    want = {(a, b): 1 for a in range(40) for b in range(a + 1, 40)}
    want[1, 2] = 2
    assert got == want
    items = {(x.a, x.b) for x in graph.co_presence(df, "g", "p", item="item", block=block).collect()}
    assert items == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 != b % 3}


def test_no_task_gets_all_pairs_of_a_group(spark):
    rows = spark.range(400).selectExpr("'hot' as g", "id as p")
    cells = graph._pairs(rows, "g", "p", (), 50)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and cells.count() == 400 * 400
