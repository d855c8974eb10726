"""Documents packed by tf-idf: the cells of ``tf_idf``, and few bytes on the way."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import lexical
from rollcall.plans.all import QUERIES

SF = "/root/testdata/sf0.01"


def shuffled(spark):
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(d, [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(30))]) for d in range(80)]
    rows += [(7, ["w1", "new"]), (None, ["w1", "only"]), (None, ["only"]), (91, None), (92, []), (93, ["once"])]  # an id again, no id, no words, no term that stays
    return spark.createDataFrame(rows, "doc long, words array<string>").localCheckpoint()


@pytest.mark.parametrize("size,part,dealt", [(2_000_000, 2_000_000, True), (150, 40, True), (60, 60, False)])
def test_blocks_hold_the_cells_of_tf_idf(docs, size, part, dealt):
    blocks, terms, many = lexical.weighed_blocks(docs, "doc", "words", size, part=part, dealt=dealt)
    named, got = {x.t: x.term for x in terms.collect()}, {}
    found = blocks.collect()
    for x in found:
        t, n, a, w = lexical._cells(x.asDict())
        assert sorted(range(len(t)), key=lambda i: (lexical._loose(x.to, np.int32)[i], t[i])) == list(range(len(t)))
        got |= {(x.ids[i], named[j]): v for i, j, v in zip(a, np.repeat(t, n), w)}
    want = {(x.doc, x.term): x.weight for x in lexical.tf_idf(docs, "doc", "words").collect() if x.doc is not None}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
    assert len(found) <= many if dealt else len(found) > 1


def test_no_documents(spark, docs):
    assert lexical.weighed_blocks(docs.limit(0), "doc", "words", 100)[0].count() == 0
    assert lexical.similar_documents(docs.limit(0), "doc", "words", lambda i: i % 5 == 0, "q", 3).count() == 0


@pytest.mark.parametrize("block,chunk", [(30, 50)])
def test_similar_documents_are_those_of_the_cells(docs, block, chunk):
    v = lexical.tf_idf(docs, "doc", "words").where("doc is not null")
    want = lexical.similar(v.where("doc % 5 = 0").withColumnRenamed("doc", "q"), v, "q", "doc", 3)
    got = lexical.similar_documents(docs, "doc", "words", lambda i: i % 5 == 0, "q", 3, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["t18_query_cosine", "t18_close_documents"])
def test_cells_are_not_shuffled_as_rows(spark, name):
    before = shuffled(spark)
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 3 * os.path.getsize(f"{SF}/documents.parquet")


@pytest.mark.parametrize("block,part,iterations", [(8_000_000, 2_000_000, 3), (150, 40, 3), (60, 20, 7)])
def test_topics_of_documents_are_those_of_their_cells(docs, block, part, iterations):
    want = lexical.nmf_topics(lexical.tf_idf(docs, "doc", "words"), "doc", rank=3, top=4, iterations=iterations)
    got = lexical.document_topics(docs, "doc", "words", rank=3, top=4, iterations=iterations, block=block, part=part)
    rows = [sorted(((x.topic, x["rank"], x.term), x.share) for x in df.collect()) for df in (got, want)]
    assert [k for k, _ in rows[0]] == [k for k, _ in rows[1]] and len(rows[0]) == 12
    assert np.allclose([s for _, s in rows[0]], [s for _, s in rows[1]], atol=1.5e-4)


def test_files_of_earlier_steps_go(spark, docs, monkeypatch):
    gone = []
    monkeypatch.setattr(lexical, "release", lambda s: gone.append(s))
    lexical.document_topics(docs, "doc", "words", rank=2, iterations=20, block=150, part=40).collect()
    assert len(gone) == 3
