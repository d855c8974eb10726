"""Hard-negative mining by exact inner-product search over norm buckets.

Rows are sorted by the length of their vectors, longest first, into range partitions; inside a
task they come in buckets of BUCKET rows. By Cauchy-Schwarz no score of an anchor in a bucket
exceeds the product of its length and the bucket's largest. A bucket is passed over for an
anchor when that bound is below what each of its windows still needs: the window's lower limit,
or its running kth score once it has k rows.

A search has two rounds. In the first all anchors meet the part with the longest vectors, which
gives them running kth scores; in the second they meet the other parts, as far as bounds allow.
Anchors are dealt to blocks; a task has one block and one part, so neither all anchors nor all
rows meet anywhere, and what a task returns is at most k rows a window.

Positives are one search (one window without limits, rows of the same label), negatives another
(a window a positive, rows of other labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import prepare, saved
from rollcall.llm.ranges import ranged

#: Anchors of a block, about; rows of a bucket; rows of a part, about.
BLOCK, BUCKET, PART = 4096, 1024, 32768
#: Squared lengths stay under this, so that scores fit a long.
MOST = 1 << 62
NONE = -MOST

FOUND = "row long, slot int, score long, vec_id long"


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, x array<long>, norm2, dim): x is floor(scale * component); saved.

    Rows without an id, a label or a vector, or with a null or non-finite component, are left
    out; so are vectors so long that a score might not fit a long (2**31 after scaling).
    """
    raw = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()
    # a sum of squares is null, NaN or infinite as soon as a component is
    length = F.aggregate("raw", F.lit(0.0), lambda s, c: s + c * c)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), raw.alias("raw"))
    rows = rows.where(usable).where(length < F.lit(float(MOST) / 2))
    rows = rows.select("vec_id", "label", F.transform("raw", lambda c: F.floor(c)).alias("x"))
    rows = rows.withColumns({"norm2": F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c), "dim": F.size("x")})
    return saved(rows.withColumn("row", F.monotonically_increasing_id()))


def _matrix(table: pa.Table, name: str, rows: int) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _exact(a: np.ndarray, c: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Both as the fastest type in which sums of products up to ``most`` are exact."""
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return a.astype(kind), c.astype(kind)


def _kept(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of (anchor, slot, score, vec_id) columns the first k by score, then id, of each slot."""
    both = np.concatenate(found, axis=1)
    both = both[:, np.lexsort((both[3], -both[2], both[1], both[0]))]
    new = np.ones(both.shape[1], bool)
    new[1:] = (both[0, 1:] != both[0, :-1]) | (both[1, 1:] != both[1, :-1])
    at = np.arange(both.shape[1])
    return both[:, at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _search(k: int, same: bool):
    """The best k rows of a part for each window of the anchors of a block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["row", "slot", "score", "vec_id"])
        n, m = rows.num_rows, anchors.num_rows
        if not n or not m:
            return empty
        length = np.sqrt(rows["norm2"].to_numpy().astype(float))
        order = np.argsort(-length, kind="stable")
        length, x = length[order], _matrix(rows, "x", n)[order]
        ids, label, own = (rows[c].to_numpy()[order] for c in ("vec_id", "label", "row"))
        a, norm = _matrix(anchors, "x", m), np.sqrt(anchors["norm2"].to_numpy().astype(float))
        a_label, a_row = anchors["label"].to_numpy(), anchors["row"].to_numpy()
        low, high, kth = (_matrix(anchors, c, m).copy() for c in ("low", "high", "kth"))
        a, x = _exact(a, x, norm.max() * length[0] + 1)
        best = np.empty((4, 0), np.int64)
        for at in range(0, n, BUCKET):
            bound = norm * length[at] * (1 + 1e-12) + 1  # above any score, whatever the rounding
            need = np.where(low <= high, np.maximum(low, kth), MOST)  # an empty window needs nothing
            live = np.flatnonzero(bound >= need.min(axis=1))
            if not len(live):
                break  # later buckets are shorter still
            cut = slice(at, at + BUCKET)
            score = (a[live] @ x[cut].T).astype(np.int64)
            allowed = (a_label[live, None] == label[cut]) == same
            allowed &= a_row[live, None] != own[cut]
            more = []
            for slot in range(low.shape[1]):
                fits = allowed & (score >= np.maximum(low[live, slot], kth[live, slot])[:, None]) & (score <= high[live, slot][:, None])
                busy = np.flatnonzero(fits.any(axis=1))
                if not len(busy):
                    continue
                value = np.where(fits[busy], score[busy], NONE)
                if value.shape[1] > k:  # what is below the bucket's own kth score cannot stay
                    least = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k]
                    fits_now = fits[busy] & (value >= least[:, None])
                else:
                    fits_now = fits[busy]
                i, j = np.nonzero(fits_now)
                more.append(np.stack([live[busy[i]], np.full(len(i), slot), value[i, j], ids[at + j]]))
            if more:
                best = _kept([best, *more], k)
                group = best[0] * low.shape[1] + best[1]
                place, first, size = np.unique(group, return_index=True, return_counts=True)
                full = size == k
                worst = best[2, first[full] + k - 1]
                flat = kth.reshape(-1)
                flat[place[full]] = np.maximum(flat[place[full]], worst)
        return pa.table([pa.array(a_row[best[0]], pa.int64()), pa.array(best[1], pa.int32()), pa.array(best[2], pa.int64()), pa.array(best[3], pa.int64())], names=["row", "slot", "score", "vec_id"])

    return run


def search(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, slot, score, vec_id, rank): the first k rows, by score and then vec_id, of each
    window of each anchor, among rows of the same or of other labels, never the anchor itself.

    ``rows`` are ``prepared`` and ``ranged`` by length; ``anchors(row, label, x, norm2, dim,
    low, high)`` have a window a slot as arrays of bounds. Only vectors of one dimension meet.
    """
    parts = saved(rows.groupBy("part", "dim").agg(F.max("norm2").alias("longest")))
    first = parts.groupBy("dim").agg(F.min("part").alias("part"))
    blocks = max(1, -(-anchors.count() // BLOCK))
    waiting = saved(anchors.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "kth": F.transform("low", lambda _: F.lit(NONE))}))

    def met(pairs: DataFrame, waiting: DataFrame) -> DataFrame:
        left = rows.join(pairs, ["part", "dim"])
        right = waiting.join(pairs, ["block", "dim"])
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # anchors are rows too
        keys = ["part", "dim", "block"]
        return saved(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, same), FOUND))

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    all_blocks = waiting.select("block", "dim").distinct()
    one = met(first.join(all_blocks, "dim"), waiting)
    kth = one.groupBy("row", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    kth = kth.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("_least"))  # as long as there are slots
    now = waiting.drop("kth").join(kth, "row", "left")
    now = saved(now.withColumn("kth", F.transform("low", lambda _, i: F.coalesce(F.try_element_at("_least", i), F.lit(NONE)))).drop("_least"))
    # the shortest vectors that could still be wanted by anyone of the block
    need = F.array_min(F.transform(F.arrays_zip("low", "high", "kth"), lambda z: F.when(z["low"] <= z["high"], F.greatest(z["low"], z["kth"])).otherwise(F.lit(MOST))))
    reach = F.when(F.size("low") == 0, F.lit(float("inf"))).when(need <= 1, F.lit(0.0)).otherwise((need - 1) / F.sqrt(F.col("norm2").cast("double")) * (1 - 1e-9))
    limits = now.groupBy("block", "dim").agg(F.min(reach).alias("reach"))
    rest = parts.join(first, ["part", "dim"], "left_anti").join(limits, "dim").where(F.sqrt(F.col("longest").cast("double")) >= F.col("reach")).select("part", "dim", "block")
    return ranked(one.unionByName(met(rest, now)))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of
    ``prepared`` rows: for each row for which ``anchor`` holds and each of its first positives,
    the first rows of other labels whose score is ``least`` to ``most`` hundredths of the
    positive's.

    Ties go to the smaller id. A row is no positive of itself, but rows that share its id are
    others; an anchor that stands there twice is mined twice. An anchor without a row of its
    label, or with a positive whose score is below zero (such a window is empty), gives none.
    Vectors of other dimensions never meet. No rows give no result.
    """
    many = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))
    placed = ranged(rows, "dim", F.col("norm2").desc(), "vec_id", parts=many).drop("pos")
    anchors = saved(placed.where(anchor).select("row", F.col("vec_id").alias("anchor_id"), "label", "x", "norm2", "dim"))
    bare = anchors.drop("anchor_id")
    near = search(placed, bare.withColumns({"low": F.array(F.lit(NONE)), "high": F.array(F.lit(MOST))}), positives, same=True)
    near = saved(near.select("row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(30,0)")
    low, high = F.ceil(score * least / 100).cast("long"), F.floor(score * most / 100).cast("long")
    limits = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", low.alias("low"), high.alias("high")))).alias("_w"))  # ``positives`` at most
    windows = bare.join(limits, "row").select("*", F.col("_w.low").alias("low"), F.col("_w.high").alias("high")).drop("_w")
    # arrays of one task are one matrix, so all have as many slots; those not used are empty
    pad = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v), positives)), 1, positives)
    windows = windows.withColumns({"low": pad("low", MOST), "high": pad("high", NONE)})
    far = search(placed, windows, negatives, same=False)
    out = far.select("row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["row", "slot"])
    return out.join(anchors.select("row", "anchor_id"), "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def report(df: DataFrame) -> DataFrame:
    """``hard_negatives`` of ``embeddings``: a seventh of the ids takes the next label; anchors
    are the ids divisible by 50. What is left out is said at ``prepared``."""
    prepare(df.sparkSession)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(df, label=label), F.col("vec_id") % 50 == 0)


ORACLE = """with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)),
pairs as (select a.rid, a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.rid <> b.rid and len(a.x) = len(b.x)),
p as (select rid, anchor_id, other as positive_id, score as positive_score, row_number() over (partition by rid order by score desc, other) as slot from pairs where same qualify slot <= 5),
n as (select p.*, q.other as negative_id, q.score as negative_score, row_number() over (partition by p.rid, slot order by q.score desc, q.other) as rank
  from p join pairs q on q.rid = p.rid and not q.same and 50 * positive_score <= 100 * q.score and 100 * q.score <= 95 * positive_score qualify rank <= 3)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n"""
