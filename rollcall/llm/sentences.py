"""Substring dedup by sliding sentence spans.

A repeated span is a run of consecutive sentences with LEAST words or more that occurs
somewhere before: in a document with a smaller id, or earlier in the same text. Not every
such run has to be hashed. From each sentence the shortest run that holds LEAST words is, and
to each sentence the shortest that ends with it; every sentence of a longer repeated run lies
in one of these inside it, so the result is that of hashing all runs. A text of fewer words
is a run of its own, so that a full copy of it is found.

The first document that holds a run keeps it; elsewhere, and at every later place in the same
text, its sentences are removed. The global step joins hashes with the smallest id of each,
an aggregate that combines before its shuffle, so a run in a third of all documents costs a
row a task; the join's hot keys are split by adaptive execution.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import filled, prepare, saved

#: Words of a span that counts; words a sentence may have before it is cut.
LEAST, LONGEST = 20, 24
#: A sentence ends with . ! ? before white space, or with a line; white space belongs to it.
END = re.compile(r"[.!?]+(?:\s+|\Z)|\n\s*")
WORD = re.compile(r"\S+\s*")
LAST = (1 << 63) - 1


@lru_cache(maxsize=1 << 16)
def _ends_piece(word: str) -> bool:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % 8 == 0


def sentences(text: str | None) -> list[str]:
    """The text cut into sentences; their concatenation is the text.

    A full stop inside a token ends none. A sentence of more than LONGEST words is cut after
    words that their hash chooses (one in eight), so that pieces fall alike wherever they
    stand; a passage without any stop is thus compared, too.
    """
    out, at = [], 0
    text = text or ""
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        if end == at:
            continue
        part, start = text[at:end], at
        if part.count(" ") >= LONGEST and len(words := WORD.findall(text, at, end)) > LONGEST:
            upto = end - sum(map(len, words))
            for w in words:
                upto += len(w)
                if _ends_piece(w.rstrip()):
                    out.append(text[start:upto])
                    start = upto
        if start < end:
            out.append(text[start:end])
        at = end
    return out


def runs(sizes: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and end of the runs that are compared, from the sentences' words."""
    held = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
    n = len(sizes)
    if held[-1] < least:  # the whole text, if it has a word
        one = int(held[-1] > 0)
        return np.zeros(one, np.int64), np.full(one, n)
    ends, starts = np.searchsorted(held, held[:-1] + least), np.searchsorted(held, held[1:] - least, "right") - 1
    ahead, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate((ahead * (n + 1) + ends[ahead], starts[back] * (n + 1) + back + 1)))
    return both // (n + 1), both % (n + 1)


def _powers(r: int, n: int = 1 << 12) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, r, np.uint64))))


#: Odd multipliers, one for each half of a hash, and their inverses modulo 2^64.
_R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS = [(_powers(r), _powers(pow(r, -1, 1 << 64))) for r in _R]


def run_hashes(parts: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs that are compared; white space collapsed.

    A sentence has a 128-bit hash. That of a run is, in either half, the sum of its sentences'
    halves, each times a power of an odd number for its place, so runs come from differences
    of running sums.
    """
    words = [p.split() for p in parts]
    starts, ends = runs([len(w) for w in words], least)
    if not len(starts):
        return starts, ends, np.zeros((0, 2), np.int64)
    digest = xxhash.xxh3_128_digest
    each = np.frombuffer(b"".join([digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]), np.uint64).reshape(-1, 2)
    out = np.empty((len(starts), 2), np.uint64)
    for half, (r, (power, inverse)) in enumerate(zip(_R, _POWERS)):
        if len(parts) >= len(power):
            power, inverse = _powers(r, len(parts) + 1), _powers(pow(r, -1, 1 << 64), len(parts) + 1)
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each[:, half] * power[:len(parts)])))
        out[:, half] = (upto[ends] - upto[starts]) * inverse[starts]
    return starts, ends, out.view(np.int64)


def _again(parts: list[str], least: int) -> list[tuple[int, int]]:
    """Runs that the text itself has had before; none unless a sentence comes twice."""
    bare = [" ".join(p.split()) for p in parts]
    if len(set(bare)) == len(bare):
        return []
    seen, out = set(), []
    for i, e, x in zip(*(a.tolist() for a in run_hashes(parts, least))):
        if (key := tuple(x)) in seen:
            out.append((i, e))
        seen.add(key)
    return out


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(df.sparkSession)
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(filled(text)).alias("body"))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, body, places array<int>): runs that an earlier document holds, by document, as
    places in the list that ``run_hashes`` gives.

    ``body`` is a hash of the text, so that rows sharing an id but not a text stay apart.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(LAST).to_numpy()
            each = [run_hashes(sentences(t), least)[2] for t in b.column(1).to_pylist()]
            many = [len(e) for e in each]
            keys = np.concatenate([np.zeros((0, 2), np.int64), *each])
            places = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in many)])
            cols = [np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), np.repeat(ids, many), np.repeat(b.column(2).to_numpy(), many), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "doc_id", "body", "at"])

    spans = _prepared(df, id_col, text_col).mapInArrow(spread, "k1 long, k2 long, doc_id long, body long, at int")
    first = spans.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").drop("last")
    later = spans.join(saved(first), ["k1", "k2"]).where("doc_id > first")
    return later.groupBy("doc_id", "body").agg(F.collect_set("at").alias("places"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, kept_sha256[, kept]): one row per input row.

    ``removed`` lists removed sentences as start-end ranges, end exclusive. A null or empty
    text has no sentence; one of fewer than ``least`` words is compared whole; texts of any
    length are read whole. Rows that share a doc_id are one document and do not
    remove from each other; rows without one come after all others. An empty table gives an
    empty result; other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, places in zip(*(c.to_pylist() for c in b.columns)):
                parts = sentences(t)
                found = _again(parts, least)
                if places:
                    starts, ends = runs([len(p.split()) for p in parts], least)
                    found += zip(starts[places].tolist(), ends[places].tolist())
                gone = {j for s, e in found for j in range(s, e)}
                kept = "".join(p for j, p in enumerate(parts) if j not in gone)
                starts = sorted(s for s in gone if s - 1 not in gone)
                ends = sorted(s + 1 for s in gone if s + 1 not in gone)
                rows.append((i, len(parts), len(gone), ",".join(f"{a}-{z}" for a, z in zip(starts, ends)),
                             hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), None if t is None else kept))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:len(names)], kinds)], names)

    names = ["doc_id", "n_sentences", "n_removed", "removed", "kept_sha256"] + ["kept"] * keep_text
    schema = "doc_id long, n_sentences long, n_removed long, removed string, kept_sha256 string" + ", kept string" * keep_text
    rows = _prepared(df, id_col, text_col)
    repeats = repeated_runs(df, id_col, text_col, least).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "places")
    joined = rows.join(repeats, (F.coalesce("doc_id", F.lit(LAST)) == F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    return joined.select("doc_id", "text", "places").mapInArrow(cut, schema)
