"""The driver's tables, and the participation table that the analytic queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources import table

A, B = "1-URGENT", "5-LOW"


class Data:
    """Tables as attributes: ``d.orders``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @property
    def taking_part(self) -> DataFrame:
        """One row an order: who (person), when (year), in which series, which item."""
        return self.orders.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("year"),
                                  F.col("o_orderpriority").alias("series"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))

    @property
    def sessions(self) -> DataFrame:
        """One row an order line: order as session, supplier as person, line as talk."""
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("person"), F.col("l_linenumber").alias("talk"), F.year("o_orderdate").alias("year"))


#: The same two tables as SQL.
TAKING_PART = """taking_part as (select o_orderkey as item, o_custkey as person, cast(year(o_orderdate) as integer) as year,
  o_orderpriority as series, o_totalprice as price, o_orderstatus as status from orders)"""
SESSIONS = """sessions as (select l_orderkey as session, l_suppkey as person, l_linenumber as talk, cast(year(o_orderdate) as integer) as year
  from lineitem join orders on l_orderkey = o_orderkey)"""
