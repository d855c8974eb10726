"""SimHash near-dedup by pivot distance tables.

A pivot table holds, for every distinct fingerprint, its Hamming distances to ``PIVOTS``
fixed reference fingerprints. By the triangle inequality two fingerprints within ``bits``
of each other differ by at most ``bits`` in every coordinate, so a pair whose largest
coordinate difference is greater is discarded unseen; what survives is verified exactly.

Tables are compared inside buckets, not globally. Fingerprints within two bits agree on at
least two of four 16-bit blocks, so six keys of two blocks bring every true pair together.
A bucket above ``BUCKET`` fingerprints is split by the same rule inside its free bits
(32, then 16, leaving 8), so no bucket exceeds max(BUCKET, 256) fingerprints however the
input clusters, and nothing is dropped. Copies are one fingerprint and are never paired.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import id_text, prepare, saved
from rollcall.llm.graph import components

WORDS, BITS, BUCKET, PIVOTS = 3, 2, 4096, 32
CHUNK = 1 << 16
BYTE_AT = np.arange(0, 2048, 256)
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, each as often as it occurs.

    A-Z is lower-cased; words are runs without ASCII white space. Fewer words than
    ``words`` make one shingle; no word (or a null text) gives 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, digest, shorter = b" ".join(tokens), xxhash.xxh64_intdigest, words - 1
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - shorter)
    lo, hi = starts[:n].tolist(), ends[min(shorter, len(tokens) - 1):].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at:at + CHUNK], hi[at:at + CHUNK])], np.uint64)
        each = h.byteswap().view(np.uint8).reshape(-1, 8) + BYTE_AT
        ones += (np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ BITS_OF).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def pivots(count: int = PIVOTS) -> np.ndarray:
    r = random.Random(20240229)
    return np.array([r.getrandbits(64) for _ in range(count)], np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    prepare(df.sparkSession)
    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks(free: int) -> list[int]:
    """Of four equal blocks of the bits set in ``free``, the masks of any two."""
    at = [k for k in range(64) if free >> k & 1]
    size = len(at) // 4
    blocks = [sum(1 << k for k in at[i * size:(i + 1) * size]) for i in range(4)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(table: DataFrame, limit: int) -> DataFrame:
    """(m1 long, key long, fp long, pivot binary): each true pair shares at least one (m1, key)."""
    full = (1 << 64) - 1

    def keyed(df: DataFrame, fixed: list[int]) -> DataFrame:
        """``mask`` holds the bits that a row's bucket already fixes; add two free blocks."""
        maps = {m: _masks(full & ~m) for m in fixed}
        choice = F.lit(None).cast("array<long>")
        for m, more in maps.items():
            choice = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(m | x)) for x in more])).otherwise(choice)
        out = df.withColumn("mask", F.explode(choice))
        return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))

    fixed, done = [0], []
    now = keyed(table.withColumn("mask", F.lit(0).cast("long")), fixed)
    for level in range(3):
        fixed = sorted({m | x for m in fixed for x in _masks(full & ~m)})
        if level == 2:  # eight free bits: at most 256 distinct fingerprints
            done.append(now)
            break
        hot = now.groupBy("mask", "key").count().where(F.col("count") > limit).select("mask", "key", F.lit(True).alias("hot"))
        split = saved(now.join(hot, ["mask", "key"], "left"))
        done.append(split.where("hot is null").drop("hot"))
        over = split.where("hot").drop("hot", "key")
        if over.isEmpty():
            break
        now = keyed(over, fixed)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _bucket_edges(fp: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one bucket. Rows are ordered by the first pivot
    distance; a row meets only those up to ``bits`` further, and of these only survivors
    of the largest coordinate difference are verified."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order].astype(np.int16)
    upto = np.searchsorted(table[:, 0], table[:, 0] + bits, "right")
    root = list(range(len(fp)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(fp) - 1):
        near = np.arange(i + 1, upto[i])
        for k in range(0, table.shape[1], 8):
            if not len(near):
                break
            near = near[np.abs(table[near, k:k + 8] - table[i, k:k + 8]).max(1) <= bits]
        if len(near):
            for j in near[np.bitwise_count(fp[near] ^ fp[i]) <= bits].tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[b] = a
                    out.append((int(fp[i].view(np.int64)), int(fp[j].view(np.int64))))
    return out


def links(table: DataFrame, bits: int = BITS, limit: int = BUCKET, count: int = PIVOTS) -> DataFrame:
    """(src, dst) links whose closure equals that of all pairs within ``bits`` (at most 2).

    ``table(fp)`` holds distinct fingerprints. Each bucket yields at most one link less than
    it has fingerprints, never all its pairs.
    """
    if bits > 2:
        raise ValueError("two of four blocks agree only for pairs within two bits")
    ref = pivots(count)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            d = np.bitwise_count(fp[:, None] ^ ref[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in d], pa.binary())], ["fp", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, held_pivot = None, [], []

        def flush() -> list[tuple[int, int]]:
            if len(held_fp) < 2:
                return []
            fp = np.array(held_fp, np.int64).view(np.uint64)
            return _bucket_edges(fp, np.frombuffer(b"".join(held_pivot), np.uint8).reshape(len(fp), -1), bits)

        for b in batches:
            edges = []
            for m, k, f, p in zip(*(b.column(n).to_pylist() for n in ("mask", "key", "fp", "pivot"))):
                if (m, k) != held_key:
                    edges += flush()
                    held_key, held_fp, held_pivot = (m, k), [], []
                held_fp.append(f)
                held_pivot.append(p)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["src", "dst"])
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in flush()], pa.int64()) for i in (0, 1)], ["src", "dst"]) if held_fp else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["src", "dst"])

    measured = saved(table.select("fp").mapInArrow(measure, "fp long, pivot binary"))
    grouped = _buckets(measured, limit).select("mask", "key", "fp", "pivot")
    return grouped.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS,
                    limit: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_fp): one row per input row.

    Null or wordless texts have fingerprint zero and link like any other. Repeated rows and
    ties each keep their row. component_id is the smallest doc_id reachable; null ids are
    ignored for it (null only if all of a component's ids are). An empty table gives an
    empty result. Other columns of ``df`` are not read.
    """
    rows = saved(fingerprints(df, id_col, text_col, words))
    groups = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    label = components(links(groups, bits, limit))
    group = groups.join(label, groups.fp == label.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("group_fp"))
    lowest = group.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    member = saved(group.join(lowest, "group_fp").select("fp", "group_fp", "component_id"))
    out = rows.join(member, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_fp")
