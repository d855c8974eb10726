"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenation.

A long text is cut into chunks that overlap, a row each, which tasks pre-tokenise in parallel.
The first chunk's boundaries are true, and from the first boundary that two neighbouring
chunks share in their overlap the later chunk's are true as well, because the pattern looks
only ahead. Stitching a document needs no more than the boundaries in its overlaps. The pieces
between those points lie in one chunk each, so tasks encode them in parallel, too, and their
ids are concatenated. A text of one chunk needs no stitching. Where an overlap holds no shared
boundary (one pre-token longer than it), the text is put together and encoded in one piece,
so the result never depends on the chunk size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import IO

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import filled, id_text, prepare, saved

CHUNK, OVERLAP, LOOK = 1 << 15, 1 << 9, 2
#: Characters of chunks that a task hands on at a time.
BATCH = 1 << 22


def _ranks(lines: IO[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Loaded once in each Python worker from the vocabulary file that every node has."""
    with open(path, "rb") as f:
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(f), special_tokens={})


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunk k starts at character k * chunk and has ``overlap`` characters of the next one."""
    return [text[s:s + chunk + overlap] for s in range(0, len(text), chunk)]


def boundaries(part: str, pattern: regex.Pattern, chunk: int, last: bool) -> tuple[list[int], list[int]]:
    """Of a chunk, from its own start: the ends of pre-tokens in the overlap before and in that
    after it. None follows white space, whose split depends on what comes next; unless the text
    ends here, neither does one so near the end that a pre-token sees fewer than LOOK
    characters more (a contraction such as 'll looks two ahead)."""
    upto = len(part) if last else len(part) - LOOK
    ends = [e for e in (0, *(m.end() for m in pattern.finditer(part))) if e <= upto and (not e or not part[e - 1].isspace())]
    return ends, [e - chunk for e in ends if e >= chunk]


def stitch(bounds: list[tuple[list[int], list[int]]], chunk: int, overlap: int) -> list[int] | None:
    """Where the piece of each chunk begins in it: at the first boundary shared with the chunk
    before, after the point where that one is true. None if some overlap has no such."""
    cuts = [0]
    for (_, tail), (head, _) in zip(bounds, bounds[1:]):
        known = {e for e in head if e <= overlap}
        shared = next((e for e in tail if e in known and e + chunk > cuts[-1]), None)
        if shared is None:
            return None
        cuts.append(shared)
    return cuts


def encode(text: str, enc: tiktoken.Encoding, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of one text by its chunks, as ``encode_texts`` makes them: those that
    ``enc.encode_ordinary(text)`` gives."""
    parts = chunks(text, chunk, overlap)
    cuts = stitch([boundaries(p, pattern, chunk, k == len(parts) - 1) for k, p in enumerate(parts)], chunk, overlap)
    if cuts is None:
        return enc.encode_ordinary(text)
    ends = [chunk + c for c in cuts[1:]] + [len(parts[-1])] if parts else []
    return [i for p, a, z in zip(parts, cuts, ends) for i in enc.encode_ordinary(p[a:z])]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _spread(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, sha, copies, k, last, part): chunks of texts, dealt to tasks one by one."""
    names = ["doc_id", "sha", "copies", "k", "last", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for b in batches:
            for doc_id, sha, copies, text in zip(*b.columns):
                text = text.as_py()
                many = -(-len(text) // chunk)
                for k in range(many):
                    rows.append((doc_id.as_py(), sha.as_py(), copies.as_py(), k, k == many - 1, text[k * chunk:(k + 1) * chunk + overlap]))
                    size += len(rows[-1][-1])
                    if size > BATCH:
                        yield out()
                        size = 0
        yield out()

    once = long.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    each = once.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "copies", "text")
    return each.mapInArrow(run, "doc_id long, sha binary, copies long, k int, last boolean, part string").repartition("doc_id", "sha", "k")


def _encode_long(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids binary): little-endian 32-bit ids of texts longer than a chunk."""
    parts = saved(_spread(long, chunk, overlap))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat, ints = regex.compile(pattern), pa.list_(pa.int32())
        for b in batches:
            made = [boundaries(p.as_py(), pat, chunk, last.as_py()) for p, last in zip(b.column(4), b.column(3))]
            head, tail = [[e for e in m[0] if e <= overlap] for m in made], [m[1] for m in made]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(head, ints), pa.array(tail, ints)], ["doc_id", "sha", "k", "head", "tail"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [stitch([(x["head"], x["tail"]) for x in at.as_py()], chunk, overlap) for at in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "sha", "cuts"])

    bounds = parts.select("doc_id", "sha", "k", "last", "part").mapInArrow(scan, "doc_id long, sha binary, k int, head array<int>, tail array<int>")
    gathered = bounds.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail"))).alias("at"))
    cuts = gathered.mapInArrow(join, "doc_id long, sha binary, cuts array<int>")
    same = parts["doc_id"].eqNullSafe(cuts["doc_id"]) & (parts["sha"] == cuts["sha"])
    met = parts.join(cuts, same).select(parts["doc_id"], parts["sha"], "copies", "k", "part", F.get("cuts", "k").alias("a"), F.get("cuts", F.col("k") + 1).alias("z"), F.col("cuts").isNull().alias("whole"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids, text = [], []
            for part, a, z, whole in zip(*(b.column(i).to_pylist() for i in (4, 5, 6, 7))):
                ids.append(None if whole else _packed(enc.encode_ordinary(part[a:len(part) if z is None else chunk + z])))
                text.append(part[:chunk] if whole else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "sha", "copies", "k", "ids", "part"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = []
            for at in b.column(2).to_pylist():
                whole = at[0]["ids"] is None
                ids.append(_packed(enc.encode_ordinary("".join(x["part"] for x in at))) if whole else b"".join(x["ids"] for x in at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["doc_id", "copies", "ids"])

    pieces = met.mapInArrow(make, "doc_id long, sha binary, copies long, k int, ids binary, part string")
    whole = pieces.groupBy("doc_id", "sha", "copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "part"))).alias("at"))
    texts = whole.select("doc_id", "copies", "at").mapInArrow(end, "doc_id long, copies long, ids binary")
    return texts.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")


def _texts(df: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and longer ones."""
    prepare(df.sparkSession)
    rows = id_text(df, id_col, text_col).select("doc_id", filled(F.col("text")).alias("text"))
    return rows.where(F.char_length("text") <= chunk), rows.where(F.char_length("text") > chunk)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>), one row per row. Null counts as empty and has no id; any
    length of text is encoded whole; rows that repeat are each encoded; an empty table gives
    an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = [np.array(enc.encode_ordinary(t.as_py()), np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(i.as_py(), "<i4") for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    one, more = _texts(df, id_col, text_col, chunk)
    schema = "doc_id long, ids array<int>"
    return one.mapInArrow(run, schema).unionByName(_encode_long(more, path, pattern, chunk, overlap).mapInArrow(unpack, schema))


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, raw binary): the bytes of the ids, concatenated. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(i.as_py() or []) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    prepare(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, raw binary")


def round_trip(df: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and return
    digests of both, a row per row. What odd rows give is said at ``encode_texts``.

    For texts of one chunk the two steps run in one pass so that ids need not cross to the JVM.
    """

    def digests(encoded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoding(path, pattern)
            for b in batches:
                packed = [x if encoded else _packed(enc.encode_ordinary(x)) for x in b.column(1).to_pylist()]
                raw = [enc.decode_bytes(np.frombuffer(p, "<u4").tolist()) for p in packed]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                                                  pa.array([hashlib.sha256(r).hexdigest() for r in raw])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    one, more = _texts(df, "doc_id", "text", chunk)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return one.mapInArrow(digests(False), schema).unionByName(_encode_long(more, path, pattern, chunk, overlap).mapInArrow(digests(True), schema))
