"""Packing into token sequences by dot-product vector bin packing.

An example is a vector (tokens, segments, loss-bearing tokens), an open sequence the vector
of what it still has room for. Next comes the pooled example that fits whole and has the
largest dot product with that room, each measured against its limit. When none fits, one is
cut to fill the room exactly, so that sequences carry no padding; its rest returns to the
pool. Each task packs its own rows in one pass with a bounded pool, so nothing is shuffled,
and its last tokens go to sequences of a power of two.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollcall.llm.common import prepare

LIMIT, SEGMENTS, POOL, END, CACHE = 4096, 512, 512, 2, 400_000

_NUMBER = "0-9²³¹¼½¾"
_LETTER = "a-zªµºß-öø-ÿ"
#: Characters for which normalising and splitting are plain; other texts go to the library whole.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-\xac\xae-\xff–—‘’“”…€]*")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")

#: Byte-level vocabularies write a byte as the character of that number where it shows, and
#: the others, in order, as the characters from 256 on.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, the same as the library's.

    The vocabulary merges within words only, so each different word is encoded once and kept
    in a table of bounded size.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Straight to the merges: a plain word is normalised and split already."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if not _PLAIN.fullmatch(text) or any(t in low for t in self.special):
            return self._ids(text)
        words = _WORD.findall(low)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Packs examples one after another; ``done`` takes (key, start, length, sequence, offset)."""

    def __init__(self, emit, limit: int = LIMIT, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, first: int = 0) -> None:
        self.emit, self.limits, self.pool_size, self.sequence = emit, (limit, segments, loss or limit), pool, first
        self.keys: list[object] = [None] * (pool + 1)
        self.at = np.zeros((pool + 1, 3), np.int64)  # start, tokens left, tokens of those without loss, by pool place
        self.n = 0

    def add(self, key: object, tokens: int, silent: int = 0) -> None:
        """An example of ``tokens`` ids, of which the first ``silent`` bear no loss."""
        if tokens <= 0:
            return
        self.keys[self.n], self.at[self.n] = key, (0, tokens, min(silent, tokens))
        self.n += 1
        while self.at[self.n - 1, 1] >= self.limits[0] <= self.at[self.n - 1, 2] + self.limits[2]:
            whole = self.at[self.n - 1, 1] == self.limits[0]  # a long one fills sequences alone, so the pool stays small
            self._take(self.n - 1, self.limits[0], 0)
            self.sequence += 1
            if whole:
                return
        while self.n > self.pool_size:
            self._fill(self.limits[0])

    def finish(self) -> None:
        while self.n:
            total = int(self.at[:self.n, 1].sum())
            self._fill(min(self.limits[0], 1 << total.bit_length() - 1))

    def _take(self, i: int, many: int, offset: int) -> None:
        start, tokens, silent = self.at[i].tolist()
        self.emit(self.keys[i], start, many, self.sequence, offset)
        if many < tokens:
            self.at[i] = start + many, tokens - many, max(0, silent - many)
            return
        self.n -= 1
        self.keys[i], self.keys[self.n] = self.keys[self.n], None
        self.at[i] = self.at[self.n]

    def _fill(self, size: int) -> None:
        most = (size, self.limits[1], min(size, self.limits[2]))
        room, offset = list(most), 0
        while self.n and room[0] and room[1]:
            tokens, silent = self.at[:self.n, 1], self.at[:self.n, 2]
            loss = tokens - silent
            fits = (tokens <= room[0]) & (loss <= room[2])
            if room[1] == 1:
                fits &= tokens == room[0]
            if fits.any():
                score = tokens * (room[0] / most[0] ** 2) + room[1] / most[1] ** 2 + loss * (room[2] / most[2] ** 2)
                i = int(np.where(fits, score, -1).argmax())
                many = int(tokens[i])
            else:
                allowed = np.minimum(np.minimum(tokens, room[0]), silent + room[2])
                i = int(allowed.argmax())
                many = int(allowed[i])
                if not many:
                    break
            bearing = max(0, many - int(silent[i]))
            self._take(i, many, offset)
            offset += many
            room = [room[0] - many, room[1] - 1, room[2] - bearing]
        self.sequence += 1


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, limit: int = LIMIT,
         segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, keep_ids: bool = False, also: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), and
    the number in column ``also`` where one is named.

    An example is the ids of ``prompt_col`` (no loss), then of ``text_col``, then END. A null
    or empty text is an example of END alone. A text of any length is cut into as many
    pieces as it takes; every id lies in exactly one. Repeated rows are separate examples;
    an empty table gives no pieces; other columns are not read. Sequences are longest
    ``limit`` ids, hold at most ``segments`` pieces and ``loss`` loss-bearing ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows, kept = encoder(path), [], {}

        def emit(key: int, start: int, many: int, sequence: int, offset: int) -> None:
            doc_id, more, raw, total, left = kept[key]
            ids = raw[4 * start:4 * (start + many)]
            rows.append((doc_id, start, many, zlib.crc32(ids), total, sequence, offset, ids, more))
            if left == many:
                del kept[key]
            else:
                kept[key] = doc_id, more, raw, total, left - many

        packer = Packer(emit, limit, segments, loss, pool, TaskContext.get().partitionId() << 40)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 9
            out = [pa.array(c, pa.int64()) for c in cols[:7]]
            if keep_ids:
                out.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in cols[7]], pa.list_(pa.int32())))
            if also:
                out.append(pa.array(cols[8], pa.int64()))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        key, last = 0, END.to_bytes(4, "little")
        for b in batches:
            for doc_id, more, prompt, text in zip(*(c.to_pylist() for c in b.columns)):
                silent = enc.encode(prompt or "")
                raw = silent + enc.encode(text or "") + last
                kept[key] = doc_id, more, raw, len(raw) // 4, len(raw) // 4
                packer.add(key, len(raw) // 4, len(silent) // 4)
                key += 1
            yield batch()
        packer.finish()
        yield batch()

    prepare(df.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids + [also] * bool(also)
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    more = F.col(also).cast("long") if also else F.lit(None).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), more.alias("more"), prompt.alias("prompt"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


#: Limits for instruction data: pieces of a sequence, and ids in it that bear loss.
CHAT_SEGMENTS, CHAT_LOSS = 24, 3072


def pack_conversations(turns: DataFrame, path: str, limit: int = LIMIT, segments: int = CHAT_SEGMENTS, loss: int = CHAT_LOSS, pool: int = POOL) -> DataFrame:
    """Instruction examples of (conv_id, turn, role, text), packed: conv_id, turn and the
    columns of ``pack`` but doc_id.

    Every turn of the assistant is an example: its text bears loss, its prompt, the turn before
    it in its conversation, bears none. Where several rows have that turn, the smallest text
    is the prompt; where none has, there is no prompt. All three limits hold at once. Rows
    without a conversation or a turn have no prompt; repeated rows are separate examples; an
    empty table gives no pieces.
    """
    key = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    said = turns.where("role = 'assistant'").select(*key, F.col("text").cast("string").alias("text"))
    before = turns.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("_conv"), (F.col("turn").cast("long") + 1).alias("_turn"), F.col("text").cast("string").alias("prompt"))
    before = before.groupBy("_conv", "_turn").agg(F.min("prompt").alias("prompt"))
    examples = said.join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return pack(examples, path, "conv_id", "text", "prompt", limit, segments, loss, pool, also="turn").withColumnRenamed("doc_id", "conv_id")
