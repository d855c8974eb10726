"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Laguë.

Targets: sources share the budget by weight; what one cannot use (it stops at ``cap`` times its
size) is shared again, until a water level is found. Quotas: the mix is cut into shards of
equally many blocks of ``block`` tokens. Blocks go to the source with the highest quotient
target / (2 j + 1), where j is what it has; a shard's quotas are what its stretch of that
order awards. Blocks: a source's documents lie in seeded order, cut into blocks; after whole
rounds, the blocks of the last, partial round are spread evenly from a seeded offset.

Awards are never listed. At each cut between shards all but a few a source are certain, by
bounds on the divisor; only the doubtful ones are ranked. Whether a block is taken follows from
its number alone, so a document's taken tokens are two divisions, however long it is. Neither
documents nor sources meet on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import filled, prepare, saved
from rollcall.llm.ranges import each_of, ranged, runs

WEIGHTS, CAP, BLOCK, SHARDS, SEED = (1, 2, 3), 3, 16, 24, 11
#: Rows of a table of sources or of doubtful awards that one task sorts, about.
ROWS = 1 << 18


def words(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def seeded(seed: int, *of: Column) -> Column:
    """A text that looks random and that ``of`` and ``seed`` fix."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in of]).cast("binary"))


def ordinal(rows: DataFrame, *by: str | Column) -> DataFrame:
    """``rows`` with ``at``, their place in the order, from 0."""
    rows = saved(rows)
    placed = ranged(rows, *by, parts=max(1, -(-rows.count() // ROWS)))
    span = runs(placed).select("part", "start")
    return placed.join(span, "part").withColumn("at", F.col("start") + F.col("pos")).drop("part", "pos", "start")


def water_level(sources: DataFrame, cap: int) -> float:
    """The level at which least(cap * size, weight * level) sums to the sum of sizes.

    From below, the level of the sources that are not capped yet is Newton's step on a concave
    function with one kink a source, so it ends after few sums; two numbers a step come here.
    """
    level = 0.0
    while True:
        full = F.col("size") * cap < F.col("weight") * F.lit(level)
        free = F.when(~full, F.col("weight"))
        left, weight = sources.agg((F.sum("size") - F.coalesce(F.sum(F.when(full, F.col("size") * cap)), F.lit(0))), F.sum(free)).first()
        new = left / weight if weight else level
        if new <= level:
            return level
        level = new


def quotas(sources: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(name, quota): for each source the blocks of the first 1, 2, ... shards, as an array.

    ``sources(name, at, target)``. With d the divisor of an apportionment of m blocks among L
    sources, target / d lies within share * (m -/+ L / 2): awards below are certain, awards
    above are out. What is between is ranked by quotient, ties to the earlier source.
    """
    spark = sources.sparkSession
    some = sources.where("target > 0")
    total, many = some.agg(F.sum("target"), F.count("*")).first()
    cuts = spark.createDataFrame([(i + 1, (i + 1) * blocks // shards) for i in range(shards)], "cut int, m long")
    share = F.col("target") / F.lit(total or 1.0)
    bound = some.crossJoin(F.broadcast(cuts)).select(  # a row for each shard
        "name", "at", "target", "cut", "m", F.greatest(F.lit(0), F.floor(share * (F.col("m") - many / 2) - 0.5) - 1).alias("sure"), (F.ceil(share * (F.col("m") + many / 2) + 0.5) + 1).alias("out"))
    bound = saved(bound)
    doubt = each_of(bound.withColumn("low", F.col("sure")), "low", "out", "j").select("name", "at", "cut", "j", (-F.col("target") / (2 * F.col("j") + 1)).alias("quotient"))
    doubt = saved(doubt)
    placed = ranged(doubt, "cut", "quotient", "at", "j", parts=max(1, -(-doubt.count() // ROWS)))
    left = bound.groupBy("cut").agg((F.first("m") - F.sum("sure")).alias("left"))
    span = runs(placed, ["cut"]).join(F.broadcast(left), "cut").select("part", "cut", "first", "start", "left")  # a row for each shard
    won = placed.join(span, ["part", "cut"]).where("start + pos - first < left").groupBy("name", "cut").agg(F.count("*").alias("won"))
    each = bound.join(won, ["name", "cut"], "left").select("name", "cut", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("n"))
    made = each.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("cut", "n"))), lambda x: x["n"]).alias("quota"))  # as long as there are shards
    return sources.select("name").join(made, "name", "left").select("name", F.coalesce("quota", F.array_repeat(F.lit(0).cast("long"), shards)).alias("quota"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP,
        block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, start, blocks, offset, quota): one row
    per input row. Sources by code point, null last, get ``weights`` in turn.

    A null or empty text has no tokens and none are taken; rows without an id, and repeated
    rows, are laid out like any other, each with its own place; a source without tokens has
    target 0; a quota stops at ``cap`` rounds of all blocks of its source, so no document is
    taken more often. A source's taken tokens miss its target by a block or two. An empty table
    gives an empty result; other columns are not read.
    """
    prepare(df.sparkSession)
    name = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2"))  # sorts null last
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("name"), words(F.col(text_col).cast("string")).alias("size"))
    rows = saved(rows.withColumn("key", seeded(seed, F.col("doc_id"), F.col("size"))))
    found = rows.groupBy("name").agg(F.sum("size").alias("size"))
    turn = F.element_at(F.lit(list(weights)), (F.col("at") % len(weights) + 1).cast("int"))
    sources = saved(ordinal(found, "name").withColumn("weight", turn))
    level = water_level(sources, cap)
    sources = saved(sources.withColumn("target", F.least((F.col("size") * cap).cast("double"), F.col("weight") * F.lit(level))))
    total = sources.agg(F.sum("size")).first()[0] or 0
    quota = quotas(sources, (total + block // 2) // block, shards)
    many = F.ceil(F.col("size") / block)
    info = sources.join(quota, "name").select(
        F.col("name").alias("name"), F.col("size").alias("source_size"), "target", many.alias("blocks"),
        F.when(many > 0, F.conv(F.substring(seeded(seed, F.col("name")), 1, 15), 16, 10).cast("long") % many).otherwise(0).alias("offset"),
        F.transform("quota", lambda q: F.least(q, cap * many)).alias("quota"))
    placed = ranged(rows, "name", "key", "doc_id", "size")
    span = runs(placed, ["name"], F.col("size")).drop("first", "total").join(info, "name")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("part", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = placed.withColumn("_before", before).join(span, ["part", "name"]).withColumn("start", F.col("start") + F.col("_before"))
    each = each.withColumns({"_q": F.element_at("quota", -1), "_end": F.col("start") + F.col("size")})
    taken = F.when(F.col("blocks") > 0, F.expr("_q div blocks") * F.col("size") + _upto("_end", block) - _upto("start", block)).otherwise(0)
    source = F.when(F.col("name").startswith("1"), F.expr("substring(name, 2)"))
    return each.select("doc_id", source.alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), "start", "blocks", "offset", "quota")


def _chosen(number: str) -> str:
    """SQL: blocks of the partial round before the numbered one. Of ``blocks`` it takes
    ``_q % blocks``, as a line of that slope, from ``offset``, crosses whole numbers."""
    return f"((cast({number} as decimal(19,0)) * (_q % blocks) + offset) div blocks)"


def _upto(place: str, block: int) -> Column:
    """Tokens of the partial round before a place in the source."""
    b = f"({place} div {block})"
    return F.expr(f"{_chosen(b)} * {block} + ({_chosen(f'({b} + 1)')} - {_chosen(b)}) * ({place} % {block})")


def pieces(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, shard, turn, begin, length): the stretches of tokens that the mix takes,
    by block; ``turn`` counts the rounds through the source, ``begin`` is in the document."""
    rows = mixed.where("size > 0 and blocks > 0").withColumns({"_q": F.element_at("quota", -1), "_low": F.expr(f"start div {block}"), "_high": F.expr(f"(start + size - 1) div {block} + 1")})
    cut = each_of(rows, "_low", "_high", "_b").withColumn("_more", F.expr(f"{_chosen('(_b + 1)')} - {_chosen('_b')}"))
    cut = cut.withColumn("_turns", F.expr("_q div blocks") + F.col("_more")).where("_turns > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("_turns").cast("int") - 1)))  # at most the cap
    award = F.when(F.col("turn") < F.expr("_q div blocks"), F.col("turn") * F.col("blocks") + F.col("_b")).otherwise(F.expr(f"(_q div blocks) * blocks + {_chosen('_b')}"))
    cut = cut.withColumn("_award", award.cast("long"))
    begin, end = F.greatest("start", F.col("_b") * block), F.least(F.col("start") + F.col("size"), (F.col("_b") + 1) * block)
    shard = F.size(F.filter("quota", lambda q: q <= F.col("_award")))
    return cut.select("doc_id", "source", shard.alias("shard"), "turn", (begin - F.col("start")).alias("begin"), (end - begin).alias("length"))


def report(df: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of ``mix``; odd rows are defined there."""
    return mix(df).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select *, 1 + pos % 3 as weight, (size + {BLOCK - 1}) // {BLOCK} as n from
  (select source, sum(size)::bigint as size, row_number() over (order by source nulls last) - 1 as pos from d group by source)),
o as (select *, sum(3 * size) over w - 3 * size as capped, sum(weight) over w - weight as used, row_number() over w as k from s window w as (order by 3 * size / weight, pos)),
l as (select ((select sum(size) from s) - capped) / ((select sum(weight) from s) - used) as level, k, 3 * size as cap, weight from o),
t as (select s.*, least((3 * size)::double, weight * (select arg_min(level, k) from l where cap >= weight * level)) as target from s),
q as (select pos, count(*) as q from (select pos, row_number() over (order by target / (2 * j + 1) desc, pos, j) as r
    from (select *, unnest(range((target / {BLOCK})::bigint + (select count(*) from s) + 3)) as j from t where target > 0))
  where r <= (select (sum(size)::bigint + {BLOCK // 2}) // {BLOCK} from s) group by pos),
i as (select t.*, least(coalesce(q, 0), 3 * n)::hugeint as q, case when n > 0 then ('0x' || substr(md5('{SEED}:' || coalesce('1' || source, '2')), 1, 15))::bigint % n end as c from t left join q using (pos)),
p as (select d.doc_id, d.size, i.size as source_size, i.target, i.n, i.q, i.c,
    sum(d.size) over (partition by i.pos order by md5('{SEED}:' || coalesce(d.doc_id::varchar, '-') || ':' || d.size), d.doc_id nulls first, d.size rows unbounded preceding) as e
  from d join i on d.source is not distinct from i.source),
u as (select *, (e - size) as a, q % nullif(n, 0) as r from p)
select doc_id, size, source_size, target, case when n > 0 then (q // n * size
  + (e // {BLOCK} * r + c) // n * {BLOCK} + (((e // {BLOCK} + 1) * r + c) // n - (e // {BLOCK} * r + c) // n) * (e % {BLOCK})
  - (a // {BLOCK} * r + c) // n * {BLOCK} - (((a // {BLOCK} + 1) * r + c) // n - (a // {BLOCK} * r + c) // n) * (a % {BLOCK}))::bigint else 0 end as taken from u"""
