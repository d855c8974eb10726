"""Operators 11 to 13 against plain loops and SQL, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rollcall.llm import merkle, mixing, negatives
from rollcall.llm.queries import ORACLE_SQL, QUERIES
from rollcall.llm.ranges import each_of

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(0, 90)), r.choice(["en", "fr", None, "é"]), r.choice(["a", "b", "c", None, "𝒳", "z" * 40]), i) for i in range(150)]
    rows += [(7, "same row", "en", "a", None)] * 40 + [(None, "no id", "en", None, 3), (None, None, None, None, None), (8, None, "fr", "only null", 2), (9, "", "", "", 0), (10, "w " * 40000, "en", "long", 2**63 - 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(1) for k in ("tree", "leaf", "at", "part", "pos", "key", "name", "row", "start", "order")})


def told(spark, path, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}'")
    rel = con.execute(ORACLE_SQL[name])
    return [c[0] for c in rel.description], rel.fetchall()


@pytest.mark.parametrize(("name", "table"), [("op11_source_mix", "documents"), ("op12_hard_negatives", "embeddings"), ("op13_merkle_manifest", "documents")])
def test_equal_sql(spark, name, table):
    got = QUERIES[name](spark, SMALL)
    names, want = told(spark, f"{SMALL}/{table}.parquet", name, table)
    assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(want)


def test_each_number_without_long_arrays(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, 7, 107)], "id int, a long, b long")
    got = defaultdict(list)
    for x in each_of(df, "a", "b", "n", chunk=8).collect():
        got[x.id].append(x.n)
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(10)), 3: list(range(7, 107))}


def test_no_array_is_as_long_as_a_group(spark):
    df = spark.createDataFrame([(0, 1_000_000)], "a long, b long")
    from rollcall.llm.ranges import each_of

    got = each_of(df, "a", "b", "n").agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 0, 999_999)
    from rollcall.llm.sharding import report as shards

    same = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'' as text").unionByName(spark.range(3000).selectExpr("id as doc_id", "'x' as text"))
    rows = shards(same).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("hi")).collect()
    assert len(rows) == 24 and max(r.n for r in rows) - min(r.n for r in rows) <= 1 and all(r.n == r.d == r.hi + 1 for r in rows)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i:i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def plain_proof(levels, i, fanout):
    out = []
    for now in levels[:-1]:
        a = i - i % fanout
        run = now[a:a + fanout]
        out.append(("".join(run[:i - a]), "".join(run[i - a + 1:])))
        i //= fanout
    return out


@pytest.mark.parametrize("fanout", [2, 3, 7])
@pytest.mark.parametrize("parts", [1, 3, 70])
def test_forest_equals_plain_trees(spark, fanout, parts):
    r = random.Random(fanout * parts)
    rows = [(t, i, sha(str(t), str(i))) for t, n in (("a", 1), ("b", 2), (None, 57), ("hot", 300), ("c", 3 ** 4)) for i in range(n)]
    r.shuffle(rows)
    folder = spark.createDataFrame(rows, "tree string, place long, leaf string")
    forest = merkle.plant(merkle.saved(folder), "place", fanout=fanout, parts=parts)
    want = {t: plain_tree([x for _, _, x in sorted(y for y in rows if y[0] == t)], fanout) for t in {t for t, _, _ in rows}}
    assert {x.tree: x.root for x in merkle.roots(forest).collect()} == {t: levels[-1][0] for t, levels in want.items()}
    got = merkle.prove(forest).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.at == x.place and x.root == want[x.tree][-1][0]
        assert [(p.before, p.after) for p in x.proof] == plain_proof(want[x.tree], x.at, fanout)


def test_stack_holds_few_nodes():
    stack, most = [], 0
    for i in range(5, 5000):
        list(merkle.push(stack, (0, i, "x"), 5000, 2))
        most = max(most, len(stack))
    assert most < 2 * 13


def plain_report(rows):
    def of(i, s, k, n, t):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, k, n, t)])

    trees = defaultdict(list)
    for x in rows:
        i, n = x.doc_id, x.n_chars
        changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        trees[x.lang].append((i is not None, i or 0, of(i, x.source, x.lang, n, x.text), of(i, x.source, x.lang, n + 1, x.text) if changed else None))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    levels = {k: plain_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:3])], 2) for k in names}
    top, out = plain_tree([levels[k][-1][0] for k in names], 2), []
    for t, k in enumerate(names):
        for at, (has, i, leaf, changed) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            proof, h = plain_proof(levels[k], at, 2) + plain_proof(top, t, 2), changed or leaf
            for a, b in proof:
                h = sha(a, h, b)
            out.append((i if has else None, leaf, levels[k][-1][0], top[-1][0], sha(*[a + b for a, b in proof]), h, h == top[-1][0]))
    return out


def test_manifest_of_odd_rows(spark, odd):
    got = merkle.report(odd)
    rows = odd.collect()
    assert Counter(map(tuple, got.collect())) == Counter(plain_report(rows))
    assert not got.where("not verified").isEmpty() and merkle.report(odd.limit(0)).count() == 0
    assert [x[3] == x[1] == x[2] for x in merkle.report(odd.where("doc_id = 9").limit(1)).collect()] == [True]


# Mixing


def plain_level(sizes, weights, cap):
    level, full = 0.0, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        level = (sum(sizes) - sum(cap * sizes[i] for i in full)) / sum(weights[i] for i in free)
        more = {i for i in free if cap * sizes[i] < weights[i] * level}
        if not more:
            return level
        full |= more


def test_mix_of_odd_rows(spark, odd):
    mixed = mixing.mix(odd)
    rows = mixed.collect()
    assert len(rows) == odd.count()
    size = Counter()
    for x in odd.collect():
        size[x.source] += len((x.text or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    level = plain_level([size[s] for s in names], [weights[s] for s in names], 3)
    taken = Counter()
    for x in rows:
        assert x.source_size == size[x.source] and x.target == pytest.approx(min(3 * size[x.source], weights[x.source] * level))
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    for x in rows:
        assert abs(taken[x.source] - x.target) <= 3 * mixing.BLOCK
    again = mixing.mix(odd.repartition(5)).collect()
    key = lambda x: (x.doc_id, x.source, x.size, x.taken)
    assert Counter(map(key, rows)) == Counter(map(key, again))
    cut = mixing.pieces(mixed).collect()
    by_doc, by_shard = Counter(), defaultdict(Counter)
    for p in cut:
        assert 0 < p.length <= mixing.BLOCK and p.begin >= 0
        by_doc[p.doc_id] += p.length
        by_shard[p.source][p.shard] += p.length
    want = Counter()
    for x in rows:
        want[x.doc_id] += x.taken
    assert +want == by_doc
    quota = {x.source: x.quota for x in rows}
    blocks = spark.createDataFrame(cut).groupBy("source", "shard", "turn").count()  # pieces cut by documents, so at least the blocks
    assert blocks.count() > 0 and all(b <= a for q in quota.values() for b, a in zip(q, q[1:]))
    assert mixing.mix(odd.limit(0)).count() == 0


def plain_quotas(targets, blocks, shards):
    got, out = [0] * len(targets), []
    for done in range(1, blocks + 1):
        i = max(range(len(targets)), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[i] += 1
        for cut in range(1, shards + 1):
            if cut * blocks // shards == done:
                out.append(list(got))
    return out


def test_quotas_are_highest_quotients(spark):
    r = random.Random(4)
    targets = [r.random() * 10 ** r.randrange(1, 5) for _ in range(60)] + [7.0, 7.0, 7.0, 0.0]
    sources = spark.createDataFrame([(f"s{i:03}", i, float(t)) for i, t in enumerate(targets)], "name string, at long, target double")
    got = {x.name: x.quota for x in mixing.quotas(sources, 2000, 7).collect()}
    want = plain_quotas(targets, 2000, 7)
    assert got == {f"s{i:03}": [q[i] for q in want] for i in range(len(targets))}


def test_copies_of_a_third_of_all_rows(spark):
    rows = [(1, "a b c d e", "en", "s", 9)] * 500 + [(i, "w " * (i % 40), "en", f"s{i % 4}", 9) for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x.taken - x.target) <= 3 * mixing.BLOCK for x in got)


# Hard negatives


def plain_negatives(rows):
    kept = []
    for i, (vec, x, label) in enumerate(rows):
        if vec is None or label is None or x is None or any(c is None or c != c or abs(c) == float("inf") for c in x):
            continue
        kept.append((i, vec, (label + 1) % 10 if vec % 7 == 0 else label, [int((256 * c) // 1) for c in x]))
    out = []
    for i, vec, label, x in kept:
        if vec % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), v, k == label) for j, v, k, y in kept if j != i and len(y) == len(x))
        for s, v, _ in [t for t in scored if t[2]][:5]:
            fit = [t for t in scored if not t[2] and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(vec, v, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fit)]
    return out


def test_negatives_of_odd_rows(spark, monkeypatch):
    r = random.Random(8)
    kind = "vec_id long, embedding array<double>, label int, row int, part int, x int"
    vector = lambda n=6: [r.choice([r.gauss(0, 1), r.gauss(0, 1), 0.25]) * r.choice([1, 1, 3]) for _ in range(n)]
    rows = [(i, vector(), r.randrange(4)) for i in range(400)]
    rows += [(50, vector(), 1), (50, rows[50][1], rows[50][2]), (100, [0.0] * 6, 1), (400, None, 1), (450, vector(), None), (None, vector(), 1), (500, [1.0, None] * 3, 1), (550, [float("nan")] * 6, 1), (600, [float("inf")] * 6, 2)]
    rows += [(i, vector(3), i % 2) for i in range(1000, 1060)] + [(2000, [], 1), (2001, [], 2), (3500, [3.0], 1)] + [(7000 + i, [1.0] * 6, i % 3) for i in range(60)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], kind)
    want = Counter(plain_negatives(rows))
    assert Counter(map(tuple, negatives.report(df).collect())) == want and len(want) > 50
    for name, value in (("BUCKET", 7), ("PART", 40), ("BLOCK", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert Counter(map(tuple, negatives.report(df).collect())) == want
    assert negatives.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 5e3, 1e6])
def test_negatives_are_exact_in_each_number_type(spark, scale):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) * scale for _ in range(8)], r.randrange(3)) for i in range(200)]
    got = negatives.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert Counter(map(tuple, got.collect())) == Counter(plain_negatives(rows))


def test_short_buckets_are_pruned(monkeypatch):
    import numpy as np
    import pyarrow as pa

    seen = []
    kept = negatives._kept
    monkeypatch.setattr(negatives, "_kept", lambda found, k: seen.append(1) or kept(found, k))
    monkeypatch.setattr(negatives, "BUCKET", 10)
    x = np.array([[1000 - i] for i in range(500)])
    rows = pa.table({"row": np.arange(500), "vec_id": np.arange(500), "label": np.ones(500, int), "x": list(x), "norm2": (x ** 2).ravel()})
    anchor = pa.table({"row": [1000], "label": [1], "x": [[3]], "norm2": [9], "low": [[negatives.NONE]], "high": [[negatives.MOST]], "kth": [[negatives.NONE]]})
    got = negatives._search(5, True)(rows, anchor)
    assert got["vec_id"].to_pylist() == [0, 1, 2, 3, 4] and len(seen) == 1
