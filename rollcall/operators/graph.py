"""Typed networks: nodes, edges, projections, centrality, flows, triples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import saved


def typed_nodes(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, id, weight): rows by value of each column, columns named by kind."""
    return reduce(DataFrame.unionByName, [df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit(k))
                                          for k, c in kinds.items()])


def typed_edges(df: DataFrame, kinds: dict[str, tuple[str, str]], also: Sequence[str] = ()) -> DataFrame:
    """(source, target, edge_type, ..., weight): summed rows of each pair of columns."""
    parts = []
    for kind, (a, b) in kinds.items():
        rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        parts.append(rows.groupBy(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), *also).agg(F.count("*").alias("weight")).withColumn("edge_type", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


#: Pairs that a task makes and sums; what it holds follows from this, not from the table.
TASK_PAIRS = 500_000


def co_presence(df: DataFrame, group: str, person: str, period: str | None = None, item: str | None = None, block: int = 2000) -> DataFrame:
    """Pairs a < b present in a group: distinct groups, and distinct periods as a list.

    With ``item``, only pairs through different items count (different talks of a session).
    Members are made distinct first. Where groups give more pairs than there are persons to
    pair, persons meet in blocks as matrices, so that a pair is one row and is never shuffled.
    Else pairs are made by key within a group, in blocks where a group is large, and dealt by
    pair to as many tasks as their number asks for.
    """
    extra = [c for c in (period, item) if c]
    rows = saved(df.select(group, person, *extra).distinct())
    k = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("k"))
    made = int(k.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0)).alias("n")).first().n)
    if not extra and k.count() <= 4 * block:
        persons = rows.select(person).distinct().count()
        if made > persons * (persons - 1) / 2:
            return _met_in_blocks(rows.dropna(), group, person, persons, block)
    many = max(1, -(-made // TASK_PAIRS))
    pairs = _pairs(rows, group, person, extra, block, many).where("a < b")
    if item:
        pairs = pairs.where(F.col(f"a_{item}") != F.col(f"b_{item}"))
    years = [F.array_join(F.array_sort(F.collect_set(f"a_{period}")), ",").alias("periods")] if period else []
    once = F.count("*") if not extra else F.countDistinct(group)  # without extra columns a group gives a pair once
    return pairs.repartition(many, "a", "b").groupBy("a", "b").agg(once.alias("weight"), *years)


def _met_in_blocks(rows: DataFrame, group: str, person: str, persons: int, block: int) -> DataFrame:
    """Pairs a < b with their number of groups: blocks of persons by groups, multiplied.

    A block is one row, a bit for each person and group, and is saved once; pairs of blocks are
    a product of that table with itself, so no row is repeated or shuffled for a pair of blocks.
    """
    many = -(-persons // block)
    kind = rows.schema[person].dataType.simpleString()
    groups = rows.select(F.col(group).alias("g")).distinct()  # few, as the caller made sure
    numbered = groups.withColumn("at", F.row_number().over(Window.orderBy("g")) - 1)
    wide = groups.count()
    each = rows.select(F.col(person).alias("p"), F.col(group).alias("g"), F.pmod(F.xxhash64(person), F.lit(many)).cast("int").alias("i")).join(numbered, "g").select("i", "p", "at")

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        who, row = np.unique(part["p"].to_numpy(), return_inverse=True)
        m = np.zeros((len(who), wide), bool)
        m[row, part["at"].to_numpy()] = True
        return pd.DataFrame({"i": [part["i"].iloc[0]], "p": [who], "bits": [np.packbits(m, axis=1).tobytes()]})

    def side(p: np.ndarray, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
        # counts stay exact up to 2^24 groups
        return np.asarray(p), np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(p), -1), axis=1, count=wide).astype(np.float32)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, p, own, j, q, other in part[["i", "p", "bits", "j", "q", "other"]].itertuples(index=False):
                (x, a), (y, b) = side(p, own), side(q, other)
                for lo in range(0, len(x), 64):  # rows go out a strip at a time
                    n = a[lo:lo + 64] @ b.T
                    r, c = np.nonzero(n)
                    p, q, w = x[lo:lo + 64][r], y[c], n[r, c].astype(np.int64)
                    if i == j:
                        p, q, w = p[keep := p < q], q[keep], w[keep]
                    swap = p > q
                    yield pd.DataFrame({"a": np.where(swap, q, p), "b": np.where(swap, p, q), "weight": w})

    tasks = min(many, rows.sparkSession.sparkContext.defaultParallelism)
    blocks = saved(each.repartition(tasks, "i").groupBy("i").applyInPandas(packed, f"i int, p array<{kind}>, bits binary"))
    pairs = blocks.crossJoin(blocks.select(F.col("i").alias("j"), F.col("p").alias("q"), F.col("bits").alias("other"))).where("i <= j")
    return pairs.mapInPandas(run, f"a {kind}, b {kind}, weight long")


def _pairs(rows: DataFrame, group: str, person: str, extra: Sequence[str], block: int, many: int | None = None) -> DataFrame:
    """Ordered pairs of a group's rows with each other, all of them.

    A group of more than ``block`` rows is cut into blocks by hash of the person; its pairs are
    a triangle of pairs of blocks, each joined under its own key, so that no task gets all pairs
    of a hot group. Which group has how many blocks is one row a group. ``many`` tasks join, if given.
    """
    blocks = rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_many"))
    sized = rows.join(blocks, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_own", F.pmod(F.xxhash64(person), F.col("_many")).cast("int"))
    # a row stands in the cells (own, j) and (i, own); with a in the first place and b in the second
    other = F.explode(F.sequence(F.lit(0), F.col("_many") - 1))
    cells = lambda first: sized.withColumn("_other", other).withColumns({"_i": F.col("_own") if first else F.col("_other"), "_j": F.col("_other") if first else F.col("_own")})
    a = cells(True).select(group, "_i", "_j", F.col(person).alias("a"), *[F.col(c).alias(f"a_{c}") for c in extra])
    b = cells(False).select(group, "_i", "_j", F.col(person).alias("b"), *[F.col(c).alias(f"b_{c}") for c in extra])
    keys = [group, "_i", "_j"]
    if many:
        a, b = a.repartition(many, *keys), b.repartition(many, *keys)
    return a.join(b, keys).drop("_i", "_j")


def pruned(edges: DataFrame, least: int, enough: int) -> DataFrame:
    """Edges of at least ``least`` weight if ``enough`` of them are, else all."""
    n = F.broadcast(edges.agg(F.count(F.when(F.col("weight") >= least, 1)).alias("_n")))  # one row
    return edges.crossJoin(n).where((F.col("_n") < enough) | (F.col("weight") >= least)).drop("_n")


def top_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """Edges among the n nodes of the largest weighted degree."""
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    top = F.broadcast(ends.groupBy("node").agg(F.sum("weight").alias("w")).orderBy(F.col("w").desc(), "node").limit(n).select("node"))
    return edges.join(top, edges.a == top.node, "left_semi").join(top, edges.b == top.node, "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    return ends.groupBy("node").agg(F.countDistinct("other").alias("degree"), F.sum("weight").alias("strength"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): smallest node that can be reached, of the nodes of ``pairs`` (a, b).

    Each task first reduces its pairs to a forest, so that what is joined grows with the nodes;
    then labels go to neighbours, and to those who have a node as label, until none gets smaller.
    """

    def forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def root(x: object) -> object:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]  # halves the way
            return x

        for part in parts:
            for a, b in zip(part["a"].tolist(), part["b"].tolist()):
                if (x := root(a)) != (y := root(b)):
                    above[max(x, y)] = min(x, y)
        yield pd.DataFrame([(x, y) for x, y in above.items() if x != y], columns=["a", "b"])

    few = saved(pairs.select("a", "b").where("a <> b").mapInPandas(forest, pairs.select("a", "b").schema))
    both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    seen = None
    while True:
        low = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        label = label.join(low, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("label"))
        label = saved(label.join(label.select(F.col("node").alias("_n"), F.col("label").alias("_l")), F.col("label") == F.col("_n")).select("node", F.col("_l").alias("label")))
        now = label.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            return label
        seen = now


def betweenness(edges: DataFrame, limit: int = 8_000_000, batch: int = 256, at_once: float = 1e11) -> DataFrame:
    """(node, betweenness): shortest-path betweenness of an unweighted graph (Brandes 2001),
    each pair counted from both ends and scaled by 1 / ((n - 1)(n - 2)).

    Each component of up to ``limit`` edges is packed by one task, which searches it if that
    takes up to ``at_once`` operations; else sources are spread over tasks that read the packed
    component. Dense components are searched as matrices. Larger components stay distributed:
    searches from ``batch`` sources at a time advance level by level as joins with the edges.
    All are exact.
    """
    pairs = saved(edges.select("a", "b").where("a <> b").distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = components(pairs)
    nodes, n = label.select("node"), label.count()
    of = saved(pairs.join(label, F.col("a") == F.col("node")).select("label", "a", "b"))
    large = saved(of.groupBy("label").count().where(F.col("count") > limit).select("label"))
    sums = _searched_in_tasks(of.join(large, "label", "left_anti"), batch, at_once)
    if not large.isEmpty():
        far = label.join(large, "label", "left_semi").select("node")
        sums = sums.unionByName(_searched_by_joins(both.join(far, F.col("a") == F.col("node"), "left_semi"), far, far.count(), batch))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(sums, "node", "left").select("node", F.round(F.coalesce("s", F.lit(0.0)) * scale, 8).alias("betweenness"))


def _searched_in_tasks(of: DataFrame, batch: int, at_once: float) -> DataFrame:
    """Sums of the components of edges (label, a, b)."""
    kind = of.schema["a"].dataType.simpleString()
    many = 4 * of.sparkSession.sparkContext.defaultParallelism

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((part["a"].unique(), part["b"].unique())))
        n, a, b = len(ids), np.searchsorted(ids, part["a"].to_numpy()), np.searchsorted(ids, part["b"].to_numpy())
        dense = n * n <= 200 * len(part)  # edges go both ways
        if dense:
            graph = np.zeros((n, n), bool)
            graph[a, b] = graph[b, a] = True
            graph = np.packbits(graph, axis=0)  # rows of a column stand together
        else:
            graph = np.unique(np.concatenate((a * n + b, b * n + a)))  # both ways, by their first end
        row = {"label": [part["label"].iloc[0]], "ids": [ids], "n": [n], "dense": [dense], "graph": [b""], "sums": [b""]}
        if n * (8.0 * n * n if dense else 200.0 * len(graph)) <= at_once:
            row["sums"] = [_searched(graph, n, dense, 0, n).tobytes()]
        else:
            row["graph"] = [graph.tobytes()]
        return pd.DataFrame(row)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, ids, n, dense, graph, lo in part[["label", "ids", "n", "dense", "graph", "lo"]].itertuples(index=False):
                graph = np.frombuffer(graph, np.uint8).reshape(-1, n) if dense else np.frombuffer(graph, np.int64)
                total = _searched(graph, n, dense, lo, min(n, lo + batch))
                yield pd.DataFrame({"node": np.asarray(ids)[total > 0], "part": total[total > 0]})

    def known(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, sums in part[["ids", "sums"]].itertuples(index=False):
                yield pd.DataFrame({"node": ids, "part": np.frombuffer(sums)})

    label = of.schema["label"].dataType.simpleString()
    each = saved(of.repartition(many, "label").groupBy("label").applyInPandas(packed, f"label {label}, ids array<{kind}>, n long, dense boolean, graph binary, sums binary"))
    rest = each.where("length(graph) > 0")
    # a product, not a join by label: sources of one component go to many tasks, and its bytes are shuffled to none
    lots = saved(rest.select(F.col("label").alias("_label"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(batch).cast("long"))).alias("lo")).repartition(many))
    found = lots.crossJoin(rest.drop("sums").coalesce(8)).where("label = _label").mapInPandas(run, f"node {kind}, part double")
    found = found.unionByName(each.where("length(sums) > 0").select("ids", "sums").mapInPandas(known, f"node {kind}, part double"))
    return found.groupBy("node").agg(F.sum("part").alias("s"))


def _searched(graph: np.ndarray, n: int, dense: bool, lo: int, hi: int) -> np.ndarray:
    """What paths from nodes ``lo`` to ``hi`` add to each node."""
    total = np.zeros(n)
    if dense:
        for at in range(lo, hi, 64):
            total += _dense_dependencies(graph, np.arange(at, min(hi, at + 64)), n)
        return total
    first, target = np.searchsorted(graph, np.arange(n + 1) * n), graph % n
    for s in range(lo, hi):
        total += _dependencies(s, n, first, target)
    return total


def _dense_dependencies(bits: np.ndarray, sources: np.ndarray, n: int, strip: int = 512) -> np.ndarray:
    """``_dependencies`` of many sources, summed; ``bits`` are the graph's rows, eight in a byte."""
    def met(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ np.unpackbits(bits[:, c:c + strip], axis=0, count=n).astype(np.float64) for c in range(0, n, strip)], 1)

    own = np.arange(len(sources)), sources
    away, paths, share = np.full((len(sources), n), -1), np.zeros((len(sources), n)), np.zeros((len(sources), n))
    away[own], paths[own] = 0, 1.0
    front, level = paths.copy(), 0
    while front.any():
        reached, level = met(front), level + 1
        new = (reached > 0) & (away < 0)
        away[new], paths[new] = level, reached[new]
        front = np.where(new, reached, 0.0)
    for at in range(level - 1, 1, -1):  # no one stands between a source and itself
        below, upper = away == at, away == at - 1
        y = np.zeros_like(share)
        y[below] = (1 + share[below]) / paths[below]
        share[upper] += (paths * met(y))[upper]
    return share.sum(0)


def _dependencies(s: int, n: int, first: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What paths from node ``s`` add to each node (Brandes), a level at a time; edges of node v
    lead to ``target[first[v]:first[v + 1]]``."""
    away, paths, share = np.full(n, -1), np.zeros(n), np.zeros(n)
    away[s], paths[s] = 0, 1.0
    front, steps = np.array([s]), []
    while len(front):
        long = first[front + 1] - first[front]
        v = np.repeat(front, long)
        w = target[np.repeat(first[front] - (np.cumsum(long) - long), long) + np.arange(long.sum())]
        v, w = v[new := away[w] < 0], w[new]
        paths += np.bincount(w, paths[v], n)
        away[w] = len(steps) + 1
        steps.append((v, w))
        front = np.unique(w)
    for v, w in reversed(steps):
        share += np.bincount(v, paths[v] / paths[w] * (1 + share[w]), n)
    share[s] = 0.0
    return share


def _searched_by_joins(both: DataFrame, nodes: DataFrame, n: int, batch: int) -> DataFrame:
    many, total = -(-n // batch), None
    step = both.select(F.col("a").alias("v"), F.col("b").alias("w"))
    for i in range(many):
        levels = [saved(nodes.where(F.pmod(F.xxhash64("node"), F.lit(many)) == i).select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
        while True:  # shortest paths by level; two levels back and beyond cannot be met again
            reached = levels[-1].join(step, "v").groupBy("s", "w").agg(F.sum("paths").alias("paths")).withColumnRenamed("w", "v")
            for seen in levels[-2:]:
                reached = reached.join(seen.select("s", "v"), ["s", "v"], "left_anti")
            reached = saved(reached)
            if reached.isEmpty():
                break
            levels.append(reached)
        share = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("share"))
        for upper in reversed(levels[:-1]):
            found = share.where("s <> v").groupBy("v").agg(F.sum("share").alias("s"))
            total = found if total is None else total.unionByName(found)
            below = share.select("s", F.col("v").alias("w"), F.col("paths").alias("_p"), "share")
            part = below.join(step, "w").join(upper, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("_p") * (1 + F.col("share"))).alias("share"))
            share = saved(upper.join(part, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("share", F.lit(0.0)).alias("share")))
    return total.groupBy(F.col("v").alias("node")).agg(F.sum("s").alias("s"))


def balance(df: DataFrame, person: str, series: str, a: str, b: str) -> DataFrame:
    """Rows in two series and their balance (a - b) / total."""
    n = df.groupBy(person).agg(F.count(F.when(F.col(series) == a, 1)).alias("n_a"), F.count(F.when(F.col(series) == b, 1)).alias("n_b"))
    total = F.col("n_a") + F.col("n_b")
    return n.where(total > 0).withColumn("balance", F.round((F.col("n_a") - F.col("n_b")) / total, 4))


def lineage(pairs: DataFrame, people: DataFrame, person: str, birth: str, gap: int = 15, least: int = 2, least_unknown: int = 3) -> DataFrame:
    """Likely teacher-pupil pairs: joint work and an age gap, directed old to young; more joint
    work is asked for where a birth year is missing."""
    p = people.select(F.col(person).alias("_p"), F.col(birth).alias("_b"))
    x = pairs.join(p.withColumnsRenamed({"_p": "a", "_b": "birth_a"}), "a", "left").join(p.withColumnsRenamed({"_p": "b", "_b": "birth_b"}), "b", "left")
    known = F.col("birth_a").isNotNull() & F.col("birth_b").isNotNull()
    ok = F.when(known, (F.abs(F.col("birth_a") - F.col("birth_b")) >= gap) & (F.col("weight") >= least)).otherwise(F.col("weight") >= least_unknown)
    older = F.when(known & (F.col("birth_b") < F.col("birth_a")), F.col("b")).otherwise(F.col("a"))
    younger = F.when(older == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return x.where(ok).select(older.alias("elder"), younger.alias("younger"), "weight", F.when(known, "age_gap").otherwise("joint_work").alias("basis"))


def checked_edges(df: DataFrame, source: str, target: str, kind: str, kinds: Sequence[str], year: str, lo: int = 1700, hi: int = 2100) -> DataFrame:
    """Each edge with the rules it breaks: self loop, unknown kind, year out of range."""
    bad = F.array_compact(F.array(F.when(F.col(source) == F.col(target), "self_loop"), F.when(~F.col(kind).isin(*kinds), "unknown_kind"),
                                  F.when(~F.col(year).between(lo, hi), "bad_year")))
    return df.withColumn("problems", F.array_join(bad, ","))


def adjacency(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.groupBy(source).agg(F.array_join(F.array_sort(F.collect_set(F.col(target).cast("string"))), ",").alias("targets"), F.countDistinct(target).alias("n"))


def triples(df: DataFrame, subject: Column, properties: dict[str, tuple[Column, str]]) -> DataFrame:
    """(s, p, o, kind) for each non-null property; kind is iri, a datatype or a language tag."""
    each = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit(kind).alias("kind")) for p, (c, kind) in properties.items()])
    return df.select(subject.alias("s"), F.explode(each).alias("x")).select("s", "x.p", "x.o", "x.kind").where("o is not null").distinct()
