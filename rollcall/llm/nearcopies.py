"""Near copies at a shingle similarity of 0.8: the pipeline's stage of SimHash near-dedup.

Texts are sets of hashed five-word shingles; two link if their Jaccard similarity is at
least 0.8. Such a pair has fingerprints some 10 of 64 bits apart, so ``op1``'s two bits miss
nearly all of them, and buckets of equal fingerprint blocks that are exact for so wide a
radius would hold everything. Pairs therefore meet by minima: 128 of them, a byte each, in 32
bands of four. What meets is judged by ``op1``'s method: distances to reference fingerprints
are tabulated, a pair whose coordinates differ by more than RADIUS is discarded, as is one
whose fingerprints do, and survivors are verified exactly.

A pair of similarity 0.8 shares no band once in 20 million; it is further apart than RADIUS,
or has fewer than LIKELY equal bytes, less than once in a million each.

Equal sets are one node. A bucket of a band yields a forest of likely links from fingerprints
and bytes alone; components of these are gathered with their sets, each node once, and
searched breadth first, so that a family of copies yields a forest, never all its pairs.
Components of more than LIMIT shingles are searched bucket by bucket instead, each pair in
the first band that it shares.

No task holds more of a bucket than MOST nodes (with sets, LIMIT shingles). A larger bucket
is dealt into blocks by hash, with one node of it in each; what links there gives components
for the time being. A pair inside the bucket's largest one needs no link any more. Every other
node meets the whole bucket, block by block, so no link is lost, and a family of copies, which
is one component at once, costs what it would in a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import filled, id_text, prepare, release, saved
from rollcall.llm.graph import components
from rollcall.llm.simhash import BITS_OF, BYTE_AT, pivots

WORDS, BANDS, MINIMA, LIKELY, LIMIT, MOST, RADIUS = 5, 32, 128, 80, 1 << 22, 1 << 14, 26
CHUNK = 1 << 11
LAST = (1 << 63) - 1
_R = np.random.default_rng(20240229)
_A, _B = (_R.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)), _R.integers(0, 1 << 64, MINIMA, np.uint64)
_PIVOTS = pivots()
_TAG = np.arange(BANDS, dtype=np.int64) << 32


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles. A-Z is lower-cased; words are runs without
    ASCII white space; fewer than ``words`` make one shingle, none (or a null text) no shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    each = {digest(b" ".join(tokens[i:i + words])) for i in range(max(1, len(tokens) - words + 1))} if tokens else ()
    return np.sort(np.fromiter(each, np.uint64, len(each)))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set: a bit is 1 if set in over half the hashes; 0 for no hash."""
    each = hashes.byteswap().view(np.uint8).reshape(-1, 8) + BYTE_AT
    ones = (np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ BITS_OF).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of each of the MINIMA minima."""
    low = np.full(MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (hashes[at:at + CHUNK, None] * _A + _B).min(0))
    return (low >> np.uint64(20)).astype(np.uint8).tobytes()


def _forest(n: np.ndarray, prints: np.ndarray, sketches: np.ndarray, band: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that span the pairs for which ``linked`` holds, of those that sizes, pivot
    distances and bytes allow; in a bucket (band >= 0) only pairs that share no earlier band."""
    rest, out = np.arange(len(n)), []
    table = np.bitwise_count(prints[:, None] ^ _PIVOTS[None, :]).astype(np.int16)
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            fit = rest[(5 * n[rest] >= 4 * n[i]) & (5 * n[i] >= 4 * n[rest])]
            fit = fit[np.abs(table[fit] - table[i]).max(1, initial=0) <= RADIUS]
            fit = fit[np.bitwise_count(prints[fit] ^ prints[i]) <= RADIUS]
            fit = fit[(sketches[fit] == sketches[i]).sum(1) >= LIKELY]
            same = sketches[fit].view(np.uint32) == sketches[i].view(np.uint32)
            fit = fit[same.any(1) & ((band < 0) | (same.argmax(1) == band))]
            fit = linked(i, fit) if len(fit) else fit
            out += [(i, j) for j in fit]
            todo += fit.tolist()
            rest = np.setdiff1d(rest, fit, assume_unique=True)
    return out


def _edges(rows: list[tuple], band: int) -> list[tuple[int, int]]:
    """rows: (node, n, fp, sketch[, set]); without sets the likely links."""
    n, prints = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64).view(np.uint64)
    sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, MINIMA)

    def verified(i: int, fit: np.ndarray) -> np.ndarray:
        own, theirs = np.frombuffer(rows[i][4], np.uint64), np.frombuffer(b"".join(rows[j][4] for j in fit), np.uint64)
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n[fit])[:-1])))
        return fit[5 * both >= 4 * (n[i] + n[fit] - both)]

    found = _forest(n, prints, sketches, band, verified if len(rows[0]) > 4 else lambda i, fit: fit)
    return [(rows[i][0], rows[j][0]) for i, j in found]


def _links(grouped: DataFrame) -> DataFrame:
    """(src, dst) from rows (band, part, cell, node, n, fp, sketch[, hashes])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(edges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for b in batches:
            for *at, node, n, fp, sketch, hashes in zip(*(c.to_pylist() for c in b.columns)):
                if at != now:
                    if len(held) > 1:
                        yield out(_edges(held, now[0]))
                    now, held = at, []
                held.append((node, n, fp, sketch) if hashes is None else (node, n, fp, sketch, hashes))
        if len(held) > 1:
            yield out(_edges(held, now[0]))

    cell = ("band", "part", "cell")
    hashes = "hashes" if "hashes" in grouped.columns else F.lit(None).cast("binary").alias("hashes")
    at = grouped.select(*cell, "node", "n", "fp", "sketch", hashes).repartition(*cell).sortWithinPartitions(*cell)
    return at.mapInArrow(run, "src long, dst long").where("src <> dst").distinct()


def _linked(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(src, dst): links that join what is linked inside each bucket (band, part) of ``rows``.

    ``sizes(band, part, lead, weight)`` lists the buckets that weigh more than ``most``, with
    one node of each. Only those are cut: first into blocks, then whatever lies outside the
    bucket's largest component so far against all of it, a cell for each pair of blocks.
    """
    bucket, whole = ["band", "part"], F.lit("").alias("cell")
    sizes = saved(sizes)
    if sizes.isEmpty():
        return _links(rows.select("*", whole))
    many = F.ceil(F.col("weight") / most).cast("int")
    hot = rows.join(sizes.select(*bucket, "lead", many.alias("many")), bucket).withColumn("block", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("many") - 1))
    dealt = hot.where("node <> lead").unionByName(hot.where("node = lead").withColumn("block", everywhere))
    first = rows.join(sizes.select(*bucket), bucket, "left_anti").select("*", whole)
    links = saved(_links(first.unionByName(dealt.select(*rows.columns, F.col("block").cast("string").alias("cell")))))
    known = components(links).select("node", F.col("label").alias("own"))
    tagged = hot.join(known, "node", "left").withColumn("own", F.coalesce("own", "node"))
    main = tagged.groupBy(*bucket, "own").agg(F.count("*").alias("held")).groupBy(*bucket).agg(F.max_by("own", F.struct("held", "own")).alias("main"))
    rest = saved(tagged.join(main, bucket).where("own <> main").select(*bucket, "node", "many"))
    # as many blocks of the rest as its share of the bucket
    parts = rest.groupBy(*bucket).agg(F.count("*").alias("left")).join(hot.groupBy(*bucket).agg(F.count("*").alias("held"), F.first("many").alias("many")), bucket)
    parts = saved(parts.select(*bucket, F.ceil(F.col("left") * F.col("many") / F.col("held")).cast("int").alias("parts")))
    i, j = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), everywhere.alias("block")
    cell = F.concat_ws(":", "i", "block").alias("cell")
    some = hot.join(parts, bucket).join(rest.select(*bucket, "node"), [*bucket, "node"]).select(*rows.columns, "many", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("i"))
    every = hot.join(parts, bucket).select(*rows.columns, "block", i)
    met = some.select(*rows.columns, "i", j).select(*rows.columns, cell).unionByName(every.select(*rows.columns, cell))
    return links.unionByName(_links(met.dropDuplicates([*bucket, "cell", "node"]))).distinct()


def _signed(df: DataFrame) -> DataFrame:
    """(doc_id, body, node, n, fp, sketch): ``body`` hashes the text, ``node`` its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            cols = [b.column(0), b.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "body", "node", "n", "fp", "sketch"])

    prepare(df.sparkSession)
    return _texts(df).mapInArrow(run, "doc_id long, body long, node long, n int, fp long, sketch binary")


def _texts(df: DataFrame) -> DataFrame:
    return id_text(df).withColumn("body", F.xxhash64(filled(F.col("text"))))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, node): a row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            four = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS)
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array((four + _TAG).ravel()), pa.array(node)], ["key", "node"])

    return nodes.where("n > 0").select("node", "sketch").mapInArrow(run, "key long, node long")


def _sets(df: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes): the sets of the wanted nodes, read again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["node", "hashes"])

    one = rows.join(wanted.select("node"), "node").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("body").alias("_body"))).alias("x"))
    texts = _texts(df)
    found = texts.join(one.select("node", "x.*"), (F.coalesce("doc_id", F.lit(LAST)) == F.col("_id")) & (F.col("body") == F.col("_body")))
    return found.select("node", "text").mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def near_copies(df: DataFrame, limit: int = LIMIT, most: int = MOST, room: int = LIMIT) -> DataFrame:
    """(doc_id, body, part): one row per input row; rows of one part are linked near copies.

    Null or wordless texts have the empty set and are one part. An empty table gives an empty
    result. Columns but ``doc_id`` and ``text`` are not read. A task holds a component of
    at most ``limit`` shingles, and of a bucket blocks of ``most`` nodes or, with sets, ``room``
    shingles; the result is the same for any.
    """
    rows = saved(_signed(df))
    nodes = saved(rows.select("node", "n", "fp", "sketch").dropDuplicates(["node"]))
    keys = _keys(nodes)
    shared = saved(keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("high"), F.count("*").alias("weight")).where("lead < high").drop("high"))
    member = saved(keys.join(shared.select("key"), "key"))
    release(df.sparkSession)
    bucket = [F.shiftright("key", 32).cast("int").alias("band"), F.col("key").alias("part")]
    likely = _linked(member.join(nodes, "node").select(*bucket, "node", "n", "fp", "sketch"), shared.where(F.col("weight") > most).select(*bucket, "lead", "weight"), most)
    near = components(likely).join(nodes, "node")
    size = near.groupBy("label").agg((F.sum("n") > limit).alias("large"))
    near = saved(near.join(size, "label"))
    small = near.where("not large").select(F.lit(-1).alias("band"), F.col("label").alias("part"), "node", "n", "fp", "sketch")
    large = near.where("large").join(member, "node").select(*bucket, "node", "n", "fp", "sketch")
    heavy = large.groupBy("band", "part").agg(F.min("node").alias("lead"), F.sum("n").alias("weight")).where(F.col("weight") > room)
    sets = saved(_sets(df, rows, near))
    release(df.sparkSession)
    label = components(_linked(small.unionByName(large).join(sets, "node").select("band", "part", "node", "n", "fp", "sketch", "hashes"), heavy, room))
    parts = rows.join(label, "node", "left")
    return parts.select("doc_id", "body", F.coalesce("label", "node").alias("part"))


def first_of_each_group(df: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, one of each group of near copies: the smallest
    doc_id (rows without one come last), then the smallest hash of the text; of rows that are
    alike in both, one. All columns are returned as they are; an empty table stays empty."""
    key, ident = ["_id", "_body"], F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    parts = saved(near_copies(df).select(F.col("part"), ident.alias("_id"), F.col("body").alias("_body")))
    stay = parts.groupBy("part").agg(F.min(F.struct(*key)).alias("x")).select("x.*", F.lit(True).alias("stays"))
    judged = parts.groupBy(*key).agg(F.count("*").alias("n")).join(stay, key, "left")
    # only keys meet: those that go, and those that several rows share, of which one stays
    gone = saved(judged.where("stays is null or n > 1").select(*key, F.coalesce("stays", F.lit(False)).alias("again")))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, ident.alias("_id"), F.xxhash64(filled(F.col("text").cast("string"))).alias("_body"))
    out, again = rows.join(gone.select(*key), key, "left_anti").select("row.*"), gone.where("again").select(*key)
    return out if again.isEmpty() else out.union(rows.join(again, key, "left_semi").dropDuplicates(key).select("row.*"))
