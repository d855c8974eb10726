"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

Keys are 64-bit hashes of the normalised text. The directory starts with one bucket. A bucket
that holds more than ``capacity`` entries splits on one more leading bit; where its depth is
the directory's already, the directory doubles first, so that many slots may point to one
bucket. All the driver sees is entry counts by prefix of the buckets that are overfull. With
more entries capacity grows, so that there are at most some 2 * MOST buckets to know about.

An entry is a different text. Copies meet in an aggregate over key and text, which compares
bytes and combines before its shuffle, so a hot text costs a row a task. Entries of one key
(collisions) chain below it; a bucket of one key alone cannot split and only chains on.
Owner tasks take ranges of (bucket, key) and write them as files of the shared folder.

A document finds its bucket through the directory and its entry by key. Every document's text
is in the index, so a key with one entry is that text; in a chain the texts are compared byte
by byte.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import filled, id_text, prepare, saved

CAPACITY, MOST = 1 << 14, 1 << 13
#: Levels of splits that one count settles.
AHEAD = 6
SPACES = " \t\n\x0b\x0c\r"
_WIDE, _HALF = Decimal(10**20), Decimal(2**63)
_ENTRY = "key long, chain long, norm string, sha string, size long, best decimal(38,0)"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(filled(text), SPACES, "")


class Directory:
    """Slots by leading bits, each pointing to a bucket; a bucket knows its local depth."""

    def __init__(self) -> None:
        self.depth, self.slots = 0, [0]
        self.local, self.first = [0], [0]  # of each bucket: its depth and its first slot

    def double(self) -> None:
        self.depth, self.slots = self.depth + 1, [b for b in self.slots for _ in (0, 1)]
        self.first = [2 * i for i in self.first]

    def split(self, bucket: int) -> tuple[int, int]:
        """Halve a bucket's slots between it and a new bucket; both are a bit deeper."""
        if self.local[bucket] == self.depth:
            self.double()
        new, self.local[bucket] = len(self.local), self.local[bucket] + 1
        many = 1 << self.depth - self.local[bucket]
        at = self.first[bucket] + many
        self.local.append(self.local[bucket])
        self.first.append(at)
        self.slots[at:at + many] = [new] * many
        return bucket, new

    def prefix(self, bucket: int) -> int:
        """The leading bits that a bucket's keys share."""
        return self.first[bucket] >> self.depth - self.local[bucket]

    def lookup(self, key: Column) -> Column:
        """Bucket of a key: the slot that its leading bits name."""
        if not self.depth:
            return F.lit(0)
        return F.element_at(F.lit(self.slots), _leading(key, self.depth).cast("int") + 1)


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def grown(count: Callable[[int, dict[int, list[int]]], dict[int, tuple[int, bool]]], capacity: int) -> Directory:
    """A directory in which no bucket holds more than ``capacity`` entries, but for those of one
    key. ``count(depth, prefixes)`` gives, by prefix of ``depth`` bits, how many entries lie
    there and whether they share one key; only under the given prefixes (by their depth)."""
    d, full = Directory(), [0]
    while full:
        want: dict[int, list[int]] = {}
        for b in full:
            want.setdefault(d.local[b], []).append(d.prefix(b))
        depth = min(64, max(want) + AHEAD)
        seen, full, todo = count(depth, want), [], list(full)
        at = sorted(seen)
        upto = [0, *accumulate(seen[p][0] for p in at)]
        while todo:
            b = todo.pop()
            shift = depth - d.local[b]
            lo, hi = (bisect_left(at, d.prefix(b) + i << shift) for i in (0, 1))
            if upto[hi] - upto[lo] <= capacity or hi - lo == 1 and seen[at[lo]][1]:
                continue
            if not shift:
                full.append(b)
                continue
            todo += d.split(b)
    return d


def _order(n: Column, doc_id: Column) -> Column:
    """Most code points first, then smallest id, as one decimal, which a hash aggregate can
    keep in place; a null id comes after every other."""
    rank = F.lit(_WIDE) - F.lit(1) - (doc_id.cast("decimal(20,0)") + F.lit(_HALF))
    return (n.cast("decimal(10,0)") * F.lit(_WIDE) + F.coalesce(rank, F.lit(Decimal(0)))).cast("decimal(38,0)")


def _key(norm: Column, bits: int) -> Column:
    """The hash's first ``bits`` bits; fewer than 64 make collisions, for tests."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftright(h, 64 - bits), 64 - bits) if bits else h - h


def build_index(rows: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> tuple[DataFrame, Directory]:
    """Entries (bucket, key, chain, norm, sha, size, best), read back from the files they are
    written to, and their directory. ``chain`` counts the entries of a key; ``norm``, the text
    to compare with, is there only in chains of more than one."""
    spark = prepare(rows.sparkSession)
    root = f"{spark.sparkContext.getCheckpointDir()}/exact-{uuid.uuid4().hex}"
    norm = rows.select("doc_id", F.char_length(filled(F.col("text"))).alias("n"), normalised(F.col("text")).alias("norm"))
    met = norm.groupBy(_key(F.col("norm"), bits).alias("key"), "norm").agg(F.count("*").alias("size"), F.max(_order(F.col("n"), F.col("doc_id"))).alias("best"))
    met.select("key", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "size", "best").write.parquet(f"{root}/entries")
    entries = spark.read.schema("key long, norm string, sha string, size long, best decimal(38,0)").parquet(f"{root}/entries")

    def count(depth: int, under: dict[int, list[int]]) -> dict[int, tuple[int, bool]]:
        inside = F.lit(False)
        for level, prefixes in under.items():
            inside = inside | (_leading(F.col("key"), level).isin(prefixes) if level else F.lit(True))
        by = entries.where(inside).groupBy(_leading(F.col("key"), depth).alias("p"))
        return {r.p & (1 << depth) - 1: (r.n, r.same) for r in by.agg(F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("same")).collect()}

    directory = grown(count, max(capacity, entries.count() // MOST))
    chains = saved(entries.groupBy("key").agg(F.count("*").alias("chain")).where("chain > 1"))
    alone = entries.select("key", F.lit(1).cast("long").alias("chain"), F.lit(None).cast("string").alias("norm"), "sha", "size", "best")
    each = alone
    if not chains.isEmpty():  # only then are texts read again, to stand in their chains
        each = alone.join(chains.select("key"), "key", "left_anti").unionByName(entries.join(chains, "key"))
    owned = each.withColumn("bucket", directory.lookup(F.col("key"))).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "sha")
    owned.write.partitionBy("bucket").parquet(f"{root}/index")
    return spark.read.schema(f"{_ENTRY}, bucket int").parquet(f"{root}/index"), directory


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row.

    Texts are equal if they are the same bytes without ASCII white space; null is empty and
    empty texts are one group. Of a group the row with most code points stays, then that
    with the smallest doc_id; rows that tie in both cannot be told apart here and share
    ``kept`` (``first_copies`` keeps one of them). A null doc_id comes last. An empty table
    gives an empty result. Texts of any length are compared whole. Other columns of ``df``
    are not read.
    """
    rows = id_text(df, id_col, text_col)
    index, directory = build_index(rows, capacity, bits)
    low = F.pmod("best", F.lit(_WIDE))
    keep = F.when(low != 0, (F.lit(_WIDE) - F.lit(1) - low - F.lit(_HALF)).cast("decimal(20,0)").cast("long"))
    found = index.select("bucket", "key", "chain", F.col("norm").alias("text_of"), "sha", "size", "best", keep.alias("keep_id"))
    norm = normalised(F.col("text"))
    each = rows.select("doc_id", norm.alias("norm"), _order(F.char_length(filled(F.col("text"))), F.col("doc_id")).alias("mine"), _key(norm, bits).alias("key"))
    each = each.withColumn("bucket", directory.lookup(F.col("key")))
    met = each.drop("norm").join(found.where("chain = 1"), ["bucket", "key"])
    chained = found.where("chain > 1")
    if not chained.isEmpty():  # different texts of one key: by their bytes
        met = met.unionByName(each.join(chained, ["bucket", "key"]).where("norm = text_of").drop("norm"))
    return met.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("mine") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))


def first_copies(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``documents`` that stay, one of each group of equal texts: with the most code
    points, then the smallest doc_id (a row without one comes last). Of rows that tie in both,
    whatever else they hold, one stays. Each row is judged by its own text, so a repeated id
    does not matter. All columns are returned as they are; an empty table stays empty.
    """
    index, directory = build_index(id_text(df), capacity)
    text = F.col("text").cast("string")
    norm = normalised(text)
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(norm).alias("key"), F.sha2(norm.cast("binary"), 256).alias("sha"),
                    _order(F.char_length(filled(text)), F.col("doc_id").cast("long")).alias("best"))
    one = row.withColumn("bucket", directory.lookup(F.col("key"))).dropDuplicates(["bucket", "key", "sha", "best"])
    return one.join(index.select("bucket", "key", "sha", "best"), ["bucket", "key", "sha", "best"], "left_semi").select("row.*")


ORACLE = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id,
       first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id,
       cast(count(*) over (partition by norm) as bigint) as group_size,
       first_value(doc_id) over (partition by norm order by n desc, doc_id) = doc_id as kept,
       sha256(norm) as text_sha256
from t
"""
