"""Merkle manifest of a table: a mountain-range stack for each indexed partition.

Leaves are sorted into range partitions by tree and order, and numbered by one offset for each
run of a tree in a partition. A partition pushes its leaves on a stack; as soon as the run of
``fanout`` neighbours that the index asks for is on top (a carry in that base), it becomes its
parent. What stays on the stack are the peaks of a mountain range that rises from an unaligned
left edge and falls to an unaligned right one, a few nodes a level. Peaks of neighbouring
partitions are merged GATHER at a time by the same stack, again and again, until one node a
tree is left. The last run of a level may be short; it is hashed as it is, without padding.

A proof needs, besides the nodes of its own partition, only the run-mates that reach over the
partition's edges. Those are peaks or merged nodes, so each partition is sent a few a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import prepare, saved
from rollcall.llm.ranges import ranged, runs

FANOUT = 2
#: Leaves of a partition, about; their proofs meet in one task's memory.
PART = 32768
#: Partitions whose peaks are merged by one task.
GATHER = 64

Node = tuple[int, int, str]  # level, place in the level, digest
PROOF = "array<struct<before: string, after: string>>"
NODES = "part int, tree string, leaves long, level int, at long, digest string, top boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int, fanout: int) -> int:
    """Levels above the leaves until one node remains."""
    up = 0
    while leaves > 1:
        leaves, up = -(-leaves // fanout), up + 1
    return up


def push(stack: list[Node], node: Node, leaves: int, fanout: int) -> Iterator[Node]:
    """Puts the next node, from left to right, on the stack of a tree of ``leaves`` and does
    the carries that it completes; yields the parents made."""
    stack.append(node)
    while True:
        level, at, _ = stack[-1]
        width = -(-leaves // fanout**level)
        first = at - at % fanout
        size = min(first + fanout, width) - first
        if width == 1 or at != first + size - 1 or len(stack) < size or stack[-size][:2] != (level, first):
            return
        made = (level + 1, at // fanout, digest(*[d for _, _, d in stack[-size:]]))
        stack[-size:] = [made]
        yield made


def missing(low: int, high: int, leaves: int, fanout: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that proofs of leaves ``low`` to below ``high`` need and
    that other leaves have a part in."""
    for level in range(height(leaves, fanout)):
        span = fanout**level
        width = -(-leaves // span)
        a, b = low // span, (high - 1) // span
        left, right = a - a % fanout, min(b - b % fanout + fanout, width)
        first, last = -(-low // span), width if high == leaves else high // span  # own nodes
        lacking = [*range(left, first), *range(last, right)] if first < last else range(left, right)
        yield from ((level, at) for at in lacking)


class Forest(NamedTuple):
    """Saved leaves (``placed``), their runs, nodes above partitions, and nodes each one lacks."""

    placed: DataFrame
    spans: DataFrame
    nodes: DataFrame
    needs: DataFrame
    fanout: int


def _ordered(table: pa.Table, by: str) -> pa.Table:
    return table.take(pa.array(np.argsort(table[by].to_numpy(), kind="stable")))


def _cuts(trees: list[str | None], first: dict[str | None, tuple]) -> Iterator[tuple[int, int]]:
    """From and to of each run of one tree in the sorted rows of a part."""
    starts = sorted(x[0] for x in first.values())
    yield from zip(starts, [*starts[1:], len(trees)])


def plant(leaves: DataFrame, *by: str, fanout: int = FANOUT, parts: int | None = None) -> Forest:
    """A tree for each value of ``tree``, over ``leaf`` (hex) in the order ``by``.

    ``leaves(tree string, leaf string, ...)`` has to be saved or read from files; nulls come
    first, as a tree and in the order; further columns are carried along.
    """
    spark = prepare(leaves.sparkSession)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PART))
    placed = ranged(leaves, "tree", *by, "leaf", parts=parts)
    spans = saved(runs(placed, ["tree"]))

    def stacked(rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows = _ordered(rows, "pos")
        trees, leaf = rows["tree"].to_pylist(), rows["leaf"].to_pylist()
        at = {x["tree"]: (x["first"], x["start"], x["total"]) for x in spans.to_pylist()}
        out = []
        for a, b in _cuts(trees, at):
            (_, start, total), stack = at[trees[a]], []
            for i in range(a, b):
                for _ in push(stack, (0, start + i - a, leaf[i]), total, fanout):
                    pass
            up, part = height(total, fanout), rows["part"][0].as_py()
            out += [(part, trees[a], total, *n, n[0] == up) for n in stack]
            out += [(part, trees[a], total, *n, None, False) for n in missing(start, start + b - a, total, fanout)]
        return _table(out)

    made = placed.select("part", "pos", "tree", "leaf").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(stacked, NODES)
    made = saved(made)
    nodes = [made.where("digest is not null")]
    peaks, many = nodes[0].where("not top"), (spans.agg(F.max("part")).first()[0] or 0) + 1
    while many > 1:
        merged = saved(peaks.withColumn("part", F.floor(F.col("part") / GATHER).cast("int")).groupBy("part").applyInArrow(_merger(fanout), f"{NODES}, fresh boolean"))
        nodes.append(merged.where("fresh").drop("fresh"))
        peaks, many = merged.where("not fresh and not top").drop("fresh"), -(-many // GATHER)
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    return Forest(placed, spans, every.drop("part"), made.where("digest is null").select("part", "tree", "level", "at"), fanout)


def _table(rows: list[tuple], more: Sequence[tuple] = ()) -> pa.Table:
    kinds = [("part", pa.int32()), ("tree", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("top", pa.bool_()), *more]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _merger(fanout: int):
    def merged(peaks: pa.Table) -> pa.Table:
        """Peaks of neighbouring parts: new nodes (fresh) and what is still on the stacks."""
        trees: dict[str | None, list[tuple]] = {}
        part = peaks["part"][0].as_py()
        for x in peaks.to_pylist():
            trees.setdefault(x["tree"], []).append((x["at"] * fanout ** x["level"], x["level"], x["at"], x["digest"], x["leaves"]))
        out = []
        for tree, found in trees.items():
            stack, total = [], found[0][4]
            up = height(total, fanout)
            for _, *node, _ in sorted(found):
                out += [(part, tree, total, *n, n[0] == up, True) for n in push(stack, tuple(node), total, fanout)]
            out += [(part, tree, total, *n, n[0] == up, False) for n in stack]
        return _table(out, [("fresh", pa.bool_())])

    return merged


def roots(forest: Forest) -> DataFrame:
    """(tree, leaves, root): one row a tree."""
    return forest.nodes.where("top").select("tree", "leaves", F.col("digest").alias("root"))


def prove(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``at``, ``leaves``, ``root`` and ``proof``.

    The proof has, level by level, the digests of the run before and after the node on the
    way, each joined. ``above(tree, root, proof)`` continues it from the tree's root upwards.
    """
    kinds = forest.placed.drop("part", "pos").schema
    spans, fanout = forest.spans, forest.fanout
    if above is None:
        above = roots(forest).select("tree", "root", F.expr(f"cast(array() as {PROOF})").alias("proof"))
    up = above.select(F.col("tree").alias("_tree"), F.col("root").alias("_root"), "proof")
    sent = spans.join(up, F.col("tree").eqNullSafe(F.col("_tree"))).select("part", "tree", "first", "start", "total", F.col("_root").alias("digest"), "proof")
    known = forest.nodes.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("at").alias("_at"), "digest")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("level") == F.col("_level")) & (F.col("at") == F.col("_at"))
    lacking = forest.needs.join(known, same).select("part", "tree", "level", "at", "digest")
    extra = sent.unionByName(lacking, allowMissingColumns=True)

    def proven(rows: pa.Table, extra: pa.Table) -> pa.Table:
        rows = _ordered(rows, "pos")
        trees, leaf = rows["tree"].to_pylist(), rows["leaf"].to_pylist()
        at, outside = {}, {}
        for x in extra.to_pylist():
            if x["level"] is None:
                at[x["tree"]] = (x["first"], x["start"], x["total"], x["digest"], x["proof"])
            else:
                outside.setdefault(x["tree"], []).append((x["level"], x["at"], x["digest"]))
        place, size, root, before, after, ends = [], [], [], [], [], [0]
        for a, b in _cuts(trees, at):
            _, start, total, top, rest = at[trees[a]]
            have = [{} for _ in range(height(total, fanout) + 1)]
            stack = []
            for i in range(a, b):
                have[0][start + i - a] = leaf[i]
                for level, k, d in push(stack, (0, start + i - a, leaf[i]), total, fanout):
                    have[level][k] = d
            for level, k, d in outside.get(trees[a], ()):
                have[level][k] = d
            rest_before, rest_after = [x["before"] for x in rest], [x["after"] for x in rest]
            width = [-(-total // fanout**k) for k in range(len(have))]
            for i in range(start, start + b - a):
                k = i
                for level in range(len(have) - 1):
                    first, own = k - k % fanout, have[level]
                    last = min(first + fanout, width[level])
                    before.append("".join([own[x] for x in range(first, k)]))
                    after.append("".join([own[x] for x in range(k + 1, last)]))
                    k //= fanout
                before += rest_before
                after += rest_after
                ends.append(len(before))
            place += range(start, start + b - a)
            size += [total] * (b - a)
            root += [top] * (b - a)
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        made = [pa.array(place, pa.int64()), pa.array(size, pa.int64()), pa.array(root, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]
        own = rows.select(kinds.names)
        return pa.table([*own.columns, *made], names=[*kinds.names, "at", "leaves", "root", "proof"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return forest.placed.groupBy("part").cogroup(extra.groupBy("part")).applyInArrow(proven, f"{fields}, at long, leaves long, root string, proof {PROOF}")


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its length in bytes, ``:``, value."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda own, x: F.sha2(F.concat(x["before"], own, x["after"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), "")


def manifest(df: DataFrame, columns: Sequence[str], tree: str, order: str, fanout: int = FANOUT, **carried: Column) -> DataFrame:
    """One row per input row: ``tree``, ``order``, ``leaf``, carried columns, ``at``, ``leaves``
    (place in its tree, size of the tree), ``subroot``, ``root`` and ``proof`` up to the root.

    Rows without a tree value form a tree of their own, the first one. In a tree, rows without
    an order value come first; rows that share one follow by their leaves, and rows that are
    equal in all columns are leaves each. Trees are leaves of the tree above, by their value. A
    null is told from an empty text. An empty table gives an empty result; other columns are
    not read.
    """
    own = df.select(F.col(tree).cast("string").alias("tree"), F.col(order).alias("order"), leaf(*[F.col(c) for c in columns]).alias("leaf"), *[c.alias(k) for k, c in carried.items()])
    forest = plant(saved(own), "order", fanout=fanout)
    subroots = roots(forest).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    trees = saved(subroots)
    top = plant(trees, "name", fanout=fanout, parts=max(1, -(-trees.count() // PART)))
    above = saved(prove(top).select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "root", "proof"))
    # what is above a tree travels with its root, so a proof is whole when its task has made it
    proven = prove(forest, above.select("tree", F.concat("subroot", "root").alias("root"), "proof"))
    both = proven.withColumn("subroot", F.substring("root", 1, 64)).withColumn("root", F.substring("root", 65, 64))
    return both.select("tree", "order", "leaf", *carried, "at", "leaves", "subroot", "root", "proof")


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tampering(id_col: str = "doc_id", every: int = 7) -> Column:
    """Rows to tamper with: those whose id's checksum ``every`` divides; none without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))


def report(df: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``manifest`` over
    documents, a tree for each ``lang``; what it does with odd rows is said there. Tampered
    rows have one more in ``n_chars``; a null stays null, so such a row still verifies."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = F.when(tampering(), leaf(*[more if c == "n_chars" else F.col(c) for c in COLUMNS]))
    made = manifest(df, COLUMNS, "lang", "doc_id", changed=changed)
    back = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = made.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """with recursive
told as (select doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc
  from documents),
hashed as (select *,
    sha256(h1 || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || h2) as leaf,
    case when xor(crc, 4294967295) % 7 = 0 then sha256(h1 || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || h2) end as changed
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as h1,
      coalesce(strlen(text) || ':' || text, '-') as h2 from told)),
rows_ as (select doc_id, lang, leaf, coalesce(changed, leaf) as tried, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
    count(*) over (partition by lang) as n, row_number() over () as rid from hashed),
nodes as (select lang, 0 as level, i, leaf as h, n from rows_
  union all select lang, level + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from nodes where n > 1 group by lang, level, i // 2),
langs as (select lang, h as subroot, level as height, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (select 0 as level, i, subroot as h, n from langs
  union all select level + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from tops where n > 1 group by level, i // 2),
path as (
  select r.rid, m.level as step, string_agg(m.h, '' order by m.i) filter (m.i < r.i >> m.level) as before, string_agg(m.h, '' order by m.i) filter (m.i > r.i >> m.level) as after
    from rows_ r join nodes m on m.lang is not distinct from r.lang and m.n > 1 and m.i // 2 = (r.i >> m.level) // 2 group by r.rid, m.level
  union all
  select r.rid, g.height + m.level, string_agg(m.h, '' order by m.i) filter (m.i < g.i >> m.level), string_agg(m.h, '' order by m.i) filter (m.i > g.i >> m.level)
    from rows_ r join langs g on g.lang is not distinct from r.lang join tops m on m.n > 1 and m.i // 2 = (g.i >> m.level) // 2 group by r.rid, g.height, m.level),
fold as (select rid, 0 as step, tried as h from rows_
  union all select f.rid, f.step + 1, sha256(coalesce(p.before, '') || f.h || coalesce(p.after, '')) from fold f join path p on p.rid = f.rid and p.step = f.step)
select r.doc_id, r.leaf, g.subroot, t.h as root, sha256(coalesce(string_agg(coalesce(p.before, '') || coalesce(p.after, ''), '' order by p.step), '')) as proof_sha256,
  any_value(f.h) as folded_root, any_value(f.h) = t.h as verified
from rows_ r join langs g on g.lang is not distinct from r.lang join (select h from tops where n = 1) t on true left join path p on p.rid = r.rid
join (select rid, arg_max(h, step) as h from fold group by rid) f on f.rid = r.rid
group by r.rid, r.doc_id, r.leaf, g.subroot, t.h"""
