"""Queries read their whole tables."""

import pytest
from pyspark.sql import functions as F

from rollcall.plans.all import QUERIES
from rollcall.sources import table

from .conftest import SMALL


@pytest.mark.parametrize("name", ["t02_bigrams", "t09_two_sides", "t16_tf_idf_top3", "t17_topics"])
def test_text_queries_see_every_document(spark, name):
    ids = {r[0] for r in QUERIES[name](spark, SMALL).select("doc_id").distinct().collect()}
    assert len([i for i in ids if i % 5]) > len([i for i in ids if i % 5 == 0]) > 0


def test_networks_see_every_order(spark):
    n = table(spark, SMALL, "lineitem").select(F.countDistinct("l_suppkey")).first()[0]
    assert QUERIES["g09_degrees"](spark, SMALL).count() == n == QUERIES["g08_betweenness"](spark, SMALL).count()


def test_running_sums_see_every_person(spark):
    assert QUERIES["w11_cumulative"](spark, SMALL).count() == table(spark, SMALL, "orders").select("o_custkey").distinct().count()


def test_ratios_see_every_part(spark):
    assert QUERIES["f32_sequence_ratio"](spark, SMALL).count() == table(spark, SMALL, "part").count()
