"""Searches by blocks: no row is made for a pair, and cuts change nothing."""

import pytest

from rollcall.operators import lexical
from rollcall.plans.all import QUERIES
from tests.conftest import SMALL
from tests.test_similarity import vectors


def brute(rows, k, least):
    by = {}
    for d, t, w in rows:
        by.setdefault(d, {})[t] = w
    out = set()
    for q in (x for x in by if x % 10 == 0):
        each = [(round(sum(w * by[d].get(t, 0.0) for t, w in by[q].items()), 4), d) for d in by if d != q]
        best = sorted((-s, d) for s, d in each if s > least)[:k]
        out |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(best)}
    return out


@pytest.mark.parametrize("least", [0.0, 0.5])
@pytest.mark.parametrize("sizes", [(20, 50), (150_000, 400_000)])
def test_block_search_equals_brute_force(spark, least, sizes):
    v = vectors(spark)
    q = v.where("d % 10 = 0").withColumnRenamed("d", "q")
    got = lexical.similar(q, v, "q", "d", 3, least, *sizes)
    assert {tuple(x) for x in got.collect()} == brute([tuple(x) for x in v.collect()], 3, least)
    assert lexical.similar(q.limit(0), v, "q", "d", 3).count() == 0


@pytest.mark.parametrize("pieces", [1, 4_000_000])
def test_product_in_pieces(pieces):
    import numpy as np

    r = np.random.default_rng(1)
    x, y = (r.random((n, 40)) * (r.random((n, 40)) < np.linspace(0.02, 0.9, 40)) for n in (17, 23))

    def block(m):
        t, at = np.nonzero(m.T)
        terms, n = np.unique(t, return_counts=True)
        return np.arange(len(m)), terms, n, at, m[at, t]

    assert np.allclose(lexical._product(block(x), block(y), pieces), x @ y.T)


@pytest.mark.parametrize("name", ["t18_query_cosine", "t18_close_documents"])
def test_no_rows_by_pair_are_shuffled(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinpandas" in plan.lower() and "sum(" not in plan  # sums by pair stay in a block
