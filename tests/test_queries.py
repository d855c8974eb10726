"""Every query with SQL gives DuckDB's rows; the others give rows."""

import duckdb
import pytest

from rollcall.plans.all import QUERIES, SQL
from rollcall.sources import TABLES

from .conftest import SMALL

#: Nothing to find in tables this small.
MAY_BE_EMPTY = {"o06_difference", "p06_any_pattern", "p08_facets", "q03_duplicate_ids", "g05_pruned", "g10_lineage", "j04_dangling", "p04_like", "q05_rules"}


def shown(x):
    return f"{x:.5g}" if isinstance(x, float) else str(x)


def lines(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = lines([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(SQL[name])
    want = lines(rel.fetchall(), [c[0] for c in rel.description])
    assert got == want
    assert got[1] or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(5).count() > 0


def test_entry_is_guarded(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
