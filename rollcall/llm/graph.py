"""Connected components as DataFrame joins; no edge list ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges(src long, dst long)``: (node, label).

    Large-star and small-star steps (Kiveris et al., 2014) written as min-aggregates and
    joins. A hub's neighbours are never gathered: the aggregate combines before its shuffle
    and the join back to the edges is an ordinary inner join, whose hot keys adaptive
    execution splits. An empty input gives an empty result; self loops are ignored.
    """
    now = saved(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large.where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = saved(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    label = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
