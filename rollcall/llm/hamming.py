"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into four segments of 16 bits, each with an index from segment value to
codes. Round r probes, for every query still open, all values at distance exactly r from its
own in every segment. A code at distance d agrees with the query to within d // 4 in some
segment, so after round r everything up to distance 4 (r + 1) - 1 has been verified; a query
closes once its kth verified distance is within that. The last round (16) covers all.

Equal codes are one index entry that keeps the smallest k + 1 ids, which is all a result can
hold of them, and one query, so copies cost nothing. A pair is counted at its first meeting
only, which its two codes alone determine.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import prepare, saved

K, SEGMENTS, WIDTH = 10, 4, 16
EVERY = 50


def sign_code(vector: Column) -> Column:
    """64 bits as a long, the first component's highest: 1 where a component is above 0, so a
    null one counts as 0. Null for a null vector and for one of another length."""
    weights = F.array(*[F.lit(1 << 63 - i if i else -(1 << 63)) for i in range(64)])
    bits = F.zip_with(vector, weights, lambda x, w: F.when(x > 0, w).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) == 64, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _masks(r: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(WIDTH), r)]


def _first_meeting(r: int) -> Column:
    """Of a pair found in segment ``seg`` at radius r: no earlier (radius, segment) finds it."""
    away = F.col("query").bitwiseXOR(F.col("code"))
    at = [F.bit_count(_segment(away, s)) for s in range(SEGMENTS)]
    sooner = [(at[s] < r) | ((at[s] == r) & (F.col("seg") > s)) for s in range(SEGMENTS)]
    out = F.lit(False)
    for x in sooner:
        out = out | x
    return ~out


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest others of each query row.

    ``codes`` and ``queries`` are (vec_id, code). Ties go to the smaller id. A row is not its
    own neighbour; another row with its id is. Fewer than k others give fewer rows, and
    rows without a code or an id are neither queries nor found.
    """
    prepare(codes.sparkSession)
    have = codes.where("code is not null and vec_id is not null")
    ranked = have.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("n") <= k + 1)
    entries = saved(ranked.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                    .withColumn("low", F.element_at("ids", 1)).withColumn("many", F.size("ids")))
    segments = F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)])
    index = saved(entries.select("code", "low", "many", F.explode(segments).alias("s")).select("s.seg", "s.value", "code", "low", "many"))
    asked = saved(queries.where("code is not null and vec_id is not null").select("vec_id", "code"))
    todo = asked.select(F.col("code").alias("query")).distinct()
    best = None
    order = Window.partitionBy("query").orderBy("distance", F.col("low").asc_nulls_last(), "code")
    closed = []
    for r in range(WIDTH + 1):
        probe = todo.select("query", F.explode(F.array(*[F.lit(s) for s in range(SEGMENTS)])).alias("seg"))
        own = F.element_at(F.array(*[_segment(F.col("query"), s) for s in range(SEGMENTS)]), F.col("seg") + 1)
        probe = probe.select("query", "seg", own.alias("own")).select("query", "seg", "own", F.explode(F.lit(_masks(r))).alias("mask"))
        probe = probe.select("query", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        met = probe.join(index, ["seg", "value"]).where(_first_meeting(r))
        met = met.select("query", "code", "low", "many", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        now = met if best is None else best.unionByName(met)
        now = saved(now.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"))
        sure = SEGMENTS * (r + 1) - 1
        covered = now.where(F.col("distance") <= sure).groupBy("query").agg(F.sum("many").alias("m")).where(F.col("m") > k).select("query")
        if r < WIDTH:
            covered = saved(covered)
            todo = saved(todo.join(covered, "query", "left_anti"))
            closed.append(now.join(covered, "query", "left_semi"))
            best = saved(now.join(covered, "query", "left_anti"))
            if todo.isEmpty():
                break
        else:
            closed.append(now)
    found = closed[0]
    for c in closed[1:]:
        found = found.unionByName(c)
    wide = found.join(entries.select("code", "ids"), "code").select("query", "distance", F.posexplode("ids").alias("copy", "neighbor_id"), "code")
    place = Window.partitionBy("query").orderBy("distance", F.col("neighbor_id").asc_nulls_last(), "code", "copy")
    few = saved(wide.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1))
    listed = few.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "neighbor_id", "distance"))).alias("near"))
    pair = asked.join(listed, asked.code == listed.query).select("vec_id", "near")
    own = F.array_position(F.transform("near", lambda x: F.when(x["distance"] == 0, x["neighbor_id"])), F.col("vec_id"))
    rest = F.slice(F.filter("near", lambda x, i: F.coalesce(own, F.lit(0)) != i + 1), 1, k)
    out = pair.select(F.col("vec_id").alias("query_id"), F.posexplode(rest).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def search_embeddings(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): queries are the rows whose vec_id is divisible
    by ``every``, against all rows.

    Rows whose vector is null or has not 64 components have no code: they are neither queries
    nor found, and so are rows without an id, which no result could name. Repeated rows are
    entries each; ties go to the smaller id; an empty table gives an empty result. Other
    columns are not read.
    """
    codes = saved(df.select(F.col("vec_id").cast("long").alias("vec_id"), sign_code(F.col("embedding")).alias("code")))
    return top_k(codes, codes.where(F.col("vec_id") % every == 0), k)


ORACLE = """
with q as (select vec_id as query_id, embedding as a from embeddings where vec_id % 50 = 0),
d as (select query_id, vec_id as neighbor_id,
             list_sum(list_transform(range(1, 65), lambda i: case when (a[i] > 0) <> (embedding[i] > 0) then 1 else 0 end)) as distance
      from q join embeddings on vec_id <> query_id),
r as (select query_id, row_number() over (partition by query_id order by distance, neighbor_id) as rank, neighbor_id, distance from d)
select query_id, cast(rank as integer) as rank, neighbor_id, cast(distance as integer) as distance from r where rank <= 10
"""
