"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame only.

Every shard has VNODES points on the ring. A row belongs to the first point at or after its
own hash. A shard takes no more than its bound; rows beyond it go on clockwise to the next
point whose shard has room, so balance is guaranteed while nearly all rows stay at home.

A row's own hash is that of its id, checksum and size, so that many rows without an id, or with
one id, spread over the ring; rows that are alike in all three are counted, and only their
counts are ranked. Only counts by arc (shards times VNODES numbers) reach the driver, which
works out from which rank on the rows of an arc move and where to. Every row then finds its
shard and its place there from its rank within its arc, without any row meeting all others.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import filled, prepare
from rollcall.llm.ranges import each_of

VNODES = 128
RING, CELLS = 52, 12


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) by point. A shard's points depend on its number alone."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}") >> 64 - RING, s) for s in range(shards) for v in range(vnodes))


def arcs(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, lo, hi, arc): the ring cut at points and at cell borders; arc i ends at point i."""
    step, out, before = 1 << RING - CELLS, [], 0
    ends = [(p + 1, i) for i, (p, _) in enumerate(points)] + [(1 << RING, 0)]
    for end, arc in ends:
        at = before
        while at < end:
            stop = min(end, (at // step + 1) * step)
            out.append((at // step, at, stop, arc))
            at = stop
        before = max(before, end)
    return out


def flow(counts: dict[int, int], owner: list[int], bound: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, slot of the first): where the rows of each arc go.

    Home rows come first; then, arc by arc, what is left over walks on clockwise.
    """
    room, used, out, left = list(bound), [0] * len(bound), [], {}

    def put(arc: int, start: int, many: int, shard: int) -> int:
        take = min(many, room[shard])
        if take:
            out.append((arc, start, start + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return take

    for arc, shard in enumerate(owner):
        n = counts.get(arc, 0)
        took = put(arc, 0, n, shard)
        if took < n:
            left[arc] = took
    for arc, start in left.items():
        at, n = arc, counts[arc]
        while start < n:
            at = (at + 1) % len(owner)
            start += put(arc, start, n - start, owner[at])
    return out


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, moved): one row per input row; counts of any
    two shards differ by one at most. ``moved`` tells rows that a full shard sent on.

    A null text has size 8 and the checksum of no bytes; rows without a doc_id, and rows that
    repeat one, are placed by their texts; rows equal in id, size and checksum are
    interchangeable and take neighbouring ranks. Fewer rows than shards leave shards empty;
    an empty table gives an empty result. Other columns are not read.
    """
    spark = prepare(df.sparkSession)
    raw = filled(F.col(text_col).cast("string")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("many"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32"), 64 - RING)
    points = ring(shards, vnodes)
    table = spark.createDataFrame(arcs(points), "cell long, lo long, hi long, arc int")
    rows = rows.withColumn("place", place).withColumn("cell", F.shiftright("place", RING - CELLS))
    inside = (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
    # both tables below are bounded by the ring, shards * vnodes + 2**CELLS rows
    rows = rows.join(F.broadcast(table), "cell").where(inside).drop("cell", "lo", "hi")
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.sum("many").alias("n")).collect()}
    n = sum(counts.values())
    bound = [n // shards + (s < n % shards) for s in range(shards)]
    owner = [s for _, s in points]
    segments = spark.createDataFrame(flow(counts, owner, bound), "arc int, lo long, hi long, shard int, base long")
    ordered = rows.selectExpr("*", "sum(many) over (partition by arc order by place, doc_id, text_crc32, size rows unbounded preceding) - many as rank")
    home = F.element_at(F.lit(owner), F.col("arc") + 1)
    met = ordered.join(F.broadcast(segments), "arc").where("rank < hi and rank + many > lo")
    # a group of equal rows may be as large as a shard, so it is spread in two steps
    met = met.withColumns({"_low": F.greatest("rank", "lo"), "_high": F.least(F.col("rank") + F.col("many"), F.col("hi"))})
    each = each_of(met, "_low", "_high", "at")
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at") - F.col("lo")).cast("long").alias("slot"), (F.col("shard") != home).alias("moved"))


def report(df: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of ``assign``: one row per
    input row, under the law of equal row counts; what it does with odd rows is said there."""
    placed = assign(df, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
