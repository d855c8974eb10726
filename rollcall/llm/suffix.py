"""Substring dedup by sorted suffixes: sampled splitters, range partitions, multikey quicksort.

Suffixes are taken at anchors, not at every byte: of all GRAM-byte strings within a window of
LENGTH bytes the one with the smallest hash is the window's anchor (the leftmost of equals),
so equal windows have their anchors at the same place, wherever they occur. The steps:

1. Rows are dealt to parts. A part gathers the leading GRAM bytes of its suffixes, each once,
   and sends them to buckets: ranges between splitters that are sampled leading bytes.
2. A bucket sorts what it gets by multikey quicksort; equal neighbours are ties. Every part
   learns by a bit a suffix which of its own are tied; the others are done with.
3. For tied suffixes longer context follows: what the windows of that anchor reach. Equal
   contexts of a part travel once, with their smallest document; the others lose their
   windows at once. The context goes to the bucket of its leading bytes.
4. The bucket sorts suffixes from the anchor on, and what precedes the anchor backwards, again
   by multikey quicksort. Common lengths with the neighbour give, for every window offset,
   classes of equal windows; those that a smaller document holds are removed.

A bucket border never cuts a leading string, so equal suffixes are neighbours in one bucket,
unless that string alone would overfill a bucket. Then its windows, whole, are dealt by their
own bytes, and equal ones meet wherever their contexts lay: nothing is lost at a border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import filled, placed, prepare

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM
#: Bytes of text of a part and of a bucket, about; documents sampled for splitters at least,
#: and more of them for each range.
PART_BYTES, BUCKET_BYTES, SAMPLE, SAMPLE_RANGE = 8 << 20, 8 << 20, 2000, 3
#: Times the suffixes of a bucket that parts may send of one leading string before its windows
#: are dealt by themselves.
HOT = 1.0
LAST = (1 << 63) - 1
CHUNK = 1 << 14
_OFFSETS = np.arange(REACH + 1)
_A = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(raw: np.ndarray, length: int, base: int = _A) -> np.ndarray:
    """Polynomial hash of every ``length`` bytes, put together from powers of two."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    part, size, out, have = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if length & size:
            power = np.uint64(pow(base, size, 1 << 64))
            out = part if out is None else out[:len(out) - size] * power + part[have:]
            have += size
        if have == length:
            return _mixed(out)
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    size, out = 1, a
    while 2 * size <= width:
        out, size = f(out[:-size], out[size:]), 2 * size
    rest = width - size
    return f(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(raw: bytes) -> np.ndarray:
    """Rows (anchor, first start, last start) of the windows of a text, by start: consecutive
    windows that have the same anchor. The hash only chooses places; it is never compared
    between texts."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < LENGTH:
        return np.zeros((0, 3), np.int64)
    grams = (rolling(data, GRAM) >> np.uint64(32)).astype(np.uint32)
    lowest = sliding(grams, REACH + 1, np.minimum)
    starts = np.flatnonzero(np.concatenate((lowest[:1] == lowest[:1], lowest[1:] != lowest[:-1])))
    stops = np.append(starts[1:], len(lowest)) - 1

    def place(at: np.ndarray) -> np.ndarray:
        return at + (grams[at[:, None] + _OFFSETS] == lowest[at][:, None]).argmax(1)

    at = starts + REACH  # where the smallest falls, it is that of the string just reached
    old = np.concatenate(([True], lowest[starts[1:]] > lowest[starts[1:] - 1]))
    at[old] = place(starts[old])
    out = np.stack((at, starts, stops), 1)
    again = out[:, 0] < stops  # the same string again within reach: later windows have the later one
    if not again.any():
        return out
    each, sizes = out[again], (stops - starts + 1)[again]
    windows, run = np.repeat(each[:, 1], sizes) + _within(sizes), np.repeat(np.arange(len(sizes)), sizes)
    at = np.concatenate([place(windows[i:i + CHUNK]) for i in range(0, len(windows), CHUNK)])
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (run[1:] != run[:-1]))))
    more = np.stack((at[head], windows[head], windows[np.append(head[1:], len(at)) - 1]), 1)
    out = np.concatenate((out[~again], more))
    return out[np.argsort(out[:, 1])]


def words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte words whose order is that of the bytes."""
    pad = -rows.shape[1] % 8
    rows = np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)
    return rows.view(">u8").astype(np.uint64)


def multikey_quicksort(keys: np.ndarray, short: int = 512) -> np.ndarray:
    """The order of rows of words (Bentley and Sedgewick, 1997), all segments a step at once.

    Each unsorted segment draws a row whose word is the pivot and splits in three; the rows
    that equal it go on with the next word. Segments of up to ``short`` rows are left to one
    stable sort at the end.
    """
    n, width = keys.shape
    draw = np.random.default_rng(n)
    order, depth, segment, rest = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), []
    active = np.arange(n) if n > 1 and width else np.zeros(0, np.int64)
    while len(active):
        seg = segment[active]
        heads = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        sizes = np.diff(np.append(heads, len(active)))
        if (little := sizes <= short).any():
            few = np.repeat(little, sizes)
            rest.append(active[few])
            active, sizes = active[~few], sizes[~little]
            heads = np.cumsum(sizes) - sizes
            if not len(active):
                break
        rows = order[active]
        word = keys[rows, depth[active]]
        pivot = np.repeat(word[heads + draw.integers(0, sizes)], sizes)
        base, start = np.repeat(heads, sizes), np.zeros(len(sizes), np.int64)
        to, name = np.empty(len(active), np.int64), np.empty(len(active), np.int64)
        equal = word == pivot
        for side in (word < pivot, equal, word > pivot):
            upto = np.cumsum(side)
            many = np.add.reduceat(side.astype(np.int64), heads)
            rank = upto - np.repeat(upto[heads] - side[heads], sizes)  # from 1, among its side of the segment
            to[side] = (base + np.repeat(start, sizes) + rank - 1)[side]
            name[side] = np.repeat(heads + start, sizes)[side]
            start = start + many
        order[active[to]] = rows
        segment[active[to]] = active[name]  # a segment is named by its first place
        depth[active[to]] = depth[active] + equal
        active = active[depth[active] < width]
    if rest:
        some = np.sort(np.concatenate(rest))
        rows = order[some]
        order[some] = rows[np.lexsort((*keys[rows].T[::-1], segment[some]))]
    return order


def common(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes, how many leading ones it shares with the row before; 0 at first."""
    differ = rows[1:] != rows[:-1]
    return np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])))[:len(rows)]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … within each of consecutive stretches of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def again(doc: np.ndarray, left: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each context and window offset (0 is REACH bytes before the anchor), whether a
    context of a smaller document has the same window.

    ``data`` holds the contexts one after another, each of ``size`` bytes with ``left`` bytes
    before its anchor. Contexts may have different leading strings.
    """
    n = len(doc)
    by_doc = np.argsort(doc, kind="stable")  # so that of equal windows the first has the smallest
    place = np.empty(n, np.int64)
    place[by_doc] = np.arange(n)
    text = np.zeros((n, REACH + LENGTH), np.uint8)
    text[np.repeat(place, size), np.repeat(REACH - left, size) + _within(size)] = data
    doc, first, many = doc[by_doc], (REACH - left)[by_doc], (size - LENGTH + 1)[by_doc]
    ahead, back = text[:, REACH:], text[:, REACH - 1::-1]  # from the anchor on, and backwards from it
    by_ahead, by_back = multikey_quicksort(words(ahead)), multikey_quicksort(words(back))
    same_ahead, same_back = common(ahead[by_ahead]), common(back[by_back])
    ranks = np.empty((2, n), np.int64)
    out = np.zeros((n, REACH + 1), bool)
    for c in range(REACH + 1):
        rows = np.flatnonzero((first <= c) & (c < first + many))
        if len(rows) < 2:
            continue
        before = REACH - c  # bytes of the window before the anchor
        ranks[0, by_ahead], ranks[1, by_back] = np.cumsum(same_ahead < LENGTH - before), np.cumsum(same_back < before)
        key = ranks[0, rows] * (n + 1) + ranks[1, rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        held = doc[rows][order]
        out[rows[order], c] = held > held[np.flatnonzero(head)][np.cumsum(head) - 1]
    return out[place]


def _u(kind: str, cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, kind)


def _shrunk(cell: bytes) -> bytes:
    """Text-like bytes for the shuffle, whose own codec does little for them."""
    return len(cell).to_bytes(4, "little") + pa.compress(cell, "zstd", asbytes=True)


def _grown(cell: bytes) -> bytes:
    return pa.decompress(cell[4:], int.from_bytes(cell[:4], "little"), "zstd", asbytes=True)


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, schema)], [n for n, _ in schema])


_LONG, _BIN = pa.int64(), pa.binary()
_GRAMS = [("bucket", _LONG), ("part", _LONG), ("grams", _BIN), ("many", _BIN)]
_TIES = [("part", _LONG), ("bucket", _LONG), ("bits", _BIN)]
_CONTEXTS = [("bucket", _LONG), ("part", _LONG), ("doc", _BIN), ("left", _BIN), ("size", _BIN), ("context", _BIN), ("refs", _BIN), ("places", _BIN)]
_RUNS = [("part", _LONG), ("runs", _BIN)]
_OUT = [("doc_id", _LONG), ("n_bytes", _LONG), ("n_removed", _LONG), ("n_spans", _LONG), ("kept_sha256", pa.string())]


def _ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    names = {_LONG: "long", _BIN: "binary", pa.string(): "string"}
    return ", ".join(f"{n} {names[k]}" for n, k in schema)


class Part:
    """The rows of a part in a fixed order, their anchors, and the leading strings of these in
    byte order, each once, with their buckets."""

    def __init__(self, rows: pa.Table, splitters: np.ndarray) -> None:
        doc, body = (rows.column(c).to_numpy() for c in ("doc", "body"))
        self.order = np.lexsort((body, doc))
        self.doc, raw = doc[self.order], rows.column("raw").to_pylist()
        self.raw = [raw[i] for i in self.order.tolist()]
        each = [anchors(r) for r in self.raw]
        self.row = np.repeat(np.arange(len(each)), [len(a) for a in each])
        self.runs = np.concatenate([np.zeros((0, 3), np.int64), *each])
        lead = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(r, np.uint8), GRAM)[a[:, 0]] for r, a in zip(self.raw, each) if len(a)]
        keys = words(np.concatenate([np.zeros((0, GRAM), np.uint8), *lead]))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        sorted_keys = keys[order]
        head = np.concatenate(([True], (sorted_keys[1:] != sorted_keys[:-1]).any(1)))[:len(order)]
        self.grams = sorted_keys[head]
        self.gram = np.empty(len(order), np.int64)
        self.gram[order] = np.cumsum(head) - 1
        held, at = self.doc[self.row[order]], np.flatnonzero(head)
        self.many = np.minimum.reduceat(held, at) != np.maximum.reduceat(held, at) if len(at) else np.zeros(0, bool)
        self.bucket = np.searchsorted(splitters, self.grams[:, 0], "right")  # equal strings fall into one
        self.by_bucket = np.argsort(self.bucket, kind="stable")


def _cuts(a: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal values of a sorted array."""
    at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def _send_grams(splitters: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        p, number = Part(rows, splitters), rows.column("part")[0].as_py()
        bucket, grams, many = (x[p.by_bucket] for x in (p.bucket, p.grams, p.many))
        return _table(_GRAMS, [(int(bucket[a]), number, _shrunk(grams[a:z].astype(">u8").tobytes()), np.packbits(many[a:z]).tobytes()) for a, z in _cuts(bucket)])

    return run


def _find_ties(hot: int) -> Callable[[pa.Table], pa.Table]:
    """Two bits a string: whether it is tied, and whether it is too hot for one bucket."""

    def run(rows: pa.Table) -> pa.Table:
        number, bucket, cells, many = (rows.column(c).to_pylist() for c in ("part", "bucket", "grams", "many"))
        each = [_u(">u8", _grown(c)).astype(np.uint64).reshape(-1, 2) for c in cells]
        sizes = [len(e) for e in each]
        keys, inside = np.concatenate(each), np.concatenate([np.unpackbits(_u("u1", m), count=n) for m, n in zip(many, sizes)])
        order = multikey_quicksort(keys)
        ranked = keys[order]
        head = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(1)))
        at, group = np.flatnonzero(head), np.cumsum(head) - 1
        count = np.diff(np.append(at, len(order)))
        tied = (count > 1) | (np.maximum.reduceat(inside[order], at) > 0)
        bits = np.empty((len(order), 2), np.uint8)
        bits[order, 0], bits[order, 1] = tied[group], (count > hot)[group]
        ends = np.cumsum(sizes).tolist()
        return _table(_TIES, [(p, b, np.packbits(bits[z - n:z]).tobytes()) for p, b, n, z in zip(number, bucket, sizes, ends)])

    return run


def _send_contexts(splitters: np.ndarray, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Contexts of tied suffixes, by bucket, each with its smallest document and the (row, start)
    where that has it; a bucket below zero is a part's own and holds the runs of later ones."""

    def run(rows: pa.Table, ties: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(_CONTEXTS, [])
        p, number = Part(rows, splitters), rows.column("part")[0].as_py()
        told = dict(zip(ties.column("bucket").to_pylist(), ties.column("bits").to_pylist()))
        bucket = p.bucket[p.by_bucket]
        bits = [np.unpackbits(_u("u1", told[int(bucket[a])]), count=2 * (z - a)).reshape(-1, 2) for a, z in _cuts(bucket)]
        flags = np.zeros((len(p.grams), 2), bool)
        flags[p.by_bucket] = np.concatenate(bits) if bits else flags[:0]
        tied = np.flatnonzero(flags[p.gram, 0])
        docs, seen, done = p.doc.tolist(), {}, []
        for row, (at, lo, hi), g in zip(p.row[tied].tolist(), p.runs[tied].tolist(), p.gram[tied].tolist()):
            context, doc = p.raw[row][lo:hi + LENGTH], docs[row]  # documents come in order
            entry = seen.get(context)
            if entry is None:
                seen[context] = (doc, at - lo, g, [(row, lo)])
            elif entry[0] == doc:
                entry[3].append((row, lo))
            else:
                done.append((row, lo, hi))
        alone, of = list(seen.items()), np.array([e[2] for e in seen.values()], np.int64)
        heat, windows, kinds = flags[of, 1], {}, {}
        for i in np.flatnonzero(heat).tolist():
            context, (doc, _, _, refs) = alone[i]
            for k in range(len(context) - LENGTH + 1):
                entry = windows.setdefault(context[k:k + LENGTH], (doc, REACH, 0, []))
                if entry[0] == doc:
                    entry[3].extend((r, s + k) for r, s in refs)
                else:
                    done.extend((r, s + k, s + k) for r, s in refs)
        for w, entry in windows.items():
            kinds.setdefault(_OWN + xxhash.xxh64_intdigest(w) % parts, []).append((w, entry))
        out = [(-1 - number, number, b"", b"", b"", b"", b"", np.array(done, "<u4").tobytes())] if done else []
        where, cool = p.bucket[of], np.flatnonzero(~heat)
        cool = cool[np.argsort(where[cool], kind="stable")]
        for a, z in _cuts(where[cool]):
            kinds[int(where[cool[a]])] = [alone[i] for i in cool[a:z].tolist()]
        for b, entries in kinds.items():
            doc, left = np.array([e[0] for _, e in entries], "<i8"), np.array([e[1] for _, e in entries], "u1")
            size, refs = np.array([len(c) for c, _ in entries], "u1"), np.array([len(e[3]) for _, e in entries], "<u4")
            places = np.array([x for _, e in entries for x in e[3]], "<u4")
            out.append((b, number, doc.tobytes(), left.tobytes(), size.tobytes(), _shrunk(b"".join(c for c, _ in entries)), refs.tobytes(), places.tobytes()))
        return _table(_CONTEXTS, out)

    return run


#: Buckets from here on hold single windows of hot leading strings, by a hash of the window.
_OWN = 1 << 62


def _compare(rows: pa.Table) -> pa.Table:
    """(part, runs): u32 triples (row, first start, last start) of repeated windows."""
    if rows.column("bucket")[0].as_py() < 0:
        return _table(_RUNS, list(zip(rows.column("part").to_pylist(), rows.column("places").to_pylist())))
    number = rows.column("part").to_pylist()
    doc, left, size, refs, places = ([_u(k, c) for c in rows.column(n).to_pylist()] for n, k in (("doc", "<i8"), ("left", "u1"), ("size", "u1"), ("refs", "<u4"), ("places", "<u4")))
    many = [len(d) for d in doc]
    of = np.repeat(np.arange(len(number)), many)
    doc, left, size, refs = np.concatenate(doc), np.concatenate(left).astype(np.int64), np.concatenate(size).astype(np.int64), np.concatenate(refs).astype(np.int64)
    places = np.concatenate(places).reshape(-1, 2).astype(np.int64)
    found = again(doc, left, size, np.concatenate([_u("u1", _grown(c)) for c in rows.column("context").to_pylist()]))
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    count = refs[row]
    which = np.repeat(row, count)
    at = places[np.repeat((np.cumsum(refs) - refs)[row], count) + _within(count)]
    base = at[:, 1] - REACH + left[which]
    runs, part = np.stack((at[:, 0], base + np.repeat(lo, count), base + np.repeat(hi, count) - 1), 1).astype("<u4"), of[which]
    return _table(_RUNS, [(number[part[a]], runs[a:z].tobytes()) for a, z in _cuts(part)])


def _cut(keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = _OUT + [("kept", _BIN)] * keep_text

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(schema, [])
        doc, body, ids, raws = (rows.column(c) for c in ("doc", "body", "doc_id", "raw"))
        order = np.lexsort((body.to_numpy(), doc.to_numpy()))
        runs = np.concatenate([np.zeros((0, 3), np.int64), *(_u("<u4", c).reshape(-1, 3).astype(np.int64) for c in found.column("runs").to_pylist())])
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        upto = np.searchsorted(runs[:, 0], np.arange(len(order) + 1))
        out, ids, raws = [], ids.to_pylist(), raws.to_pylist()
        for i, at in enumerate(order.tolist()):
            raw, own = raws[at], runs[upto[i]:upto[i + 1]]
            if not len(own):
                out.append((ids[at], len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw)[:len(schema)])
                continue
            step = np.bincount(own[:, 1], minlength=len(raw) + 1) - np.bincount(own[:, 2] + LENGTH, minlength=len(raw) + 1)
            gone = np.cumsum(step)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
            out.append((ids[at], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[:len(schema)])
        return _table(schema, out)

    return run


def _splitters(rows: DataFrame, many: int, share: int) -> np.ndarray:
    """Leading words of sampled suffixes that cut all into ``many`` ranges of about one size.
    One document in ``share`` is read, and of it one suffix in 16."""

    def run(batches):
        for b in batches:
            lead = [np.zeros((0, 8), np.uint8)]
            for raw in b.column(0).to_pylist():
                at = anchors(raw)[::16, 0]
                if len(at):
                    lead.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 8)[at])
            yield pa.RecordBatch.from_arrays([pa.array(words(np.concatenate(lead))[:, 0].view(np.int64))], ["lead"])

    some = rows.where(F.pmod(F.xxhash64("body", "doc"), F.lit(share)) == 0).select("raw").mapInArrow(run, "lead long").toPandas()["lead"]
    found = np.sort(some.to_numpy(np.int64).view(np.uint64))
    if not len(found):
        return found
    return np.unique(found[np.linspace(0, len(found), many, endpoint=False)[1:].astype(int)])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT, part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]): one row per input row.

    Texts are UTF-8 bytes, null is empty; a text under LENGTH bytes keeps all of them; texts
    of any length are read whole, and no window crosses documents. Rows that share a doc_id
    are one document and do not remove from each other; a row without one comes after all
    others. An empty table gives an empty result; other columns are not read.

    Parts and buckets hold about ``part_bytes`` and ``bucket_bytes`` of text, so their numbers
    grow with the table; a text longer than that is a part by itself. A row of the shuffle
    takes all that a part has for a bucket, so there are never more of them than leading
    strings, and far fewer while parts are few. A leading string counts as too hot for a bucket
    if more parts hold it than ``hot`` times the suffixes of a bucket.

    Texts are not shuffled: parts are saved by the tasks that read them, in buckets, and read
    again by the three steps that need them, where they lie.
    """
    prepare(df.sparkSession)
    text = filled(F.col(text_col).cast("string"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("body"), text.cast("binary").alias("raw"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("bytes")).first()
    parts, buckets = max(1, -(-size.bytes // part_bytes)), max(1, -(-size.bytes // bucket_bytes))
    splitters = _splitters(rows, buckets, max(1, size.n // (SAMPLE + SAMPLE_RANGE * buckets)))
    most = max(2, int(hot * 2 * size.bytes / (REACH + 2) / buckets))  # two anchors in REACH + 2 bytes
    # rows are parts as they come: so many neighbours of a task, long texts by themselves
    place = F.monotonically_increasing_id()
    task, at = F.shiftright(place, 33), place.bitwiseAND((1 << 33) - 1)
    many = max(1, size.n * part_bytes // max(1, size.bytes))
    dealt = F.when(F.length("raw") * 4 > part_bytes, place + F.lit(1 << 61)).otherwise(F.shiftleft(task, 33) + F.floor(at / many))
    rows = placed(rows.withColumn("part", dealt), "part", max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    grams = rows.groupBy("part").applyInArrow(_send_grams(splitters), _ddl(_GRAMS))
    ties = grams.groupBy("bucket").applyInArrow(_find_ties(most), _ddl(_TIES))
    contexts = rows.groupBy("part").cogroup(ties.groupBy("part")).applyInArrow(_send_contexts(splitters, parts), _ddl(_CONTEXTS))
    found = contexts.groupBy("bucket").applyInArrow(_compare, _ddl(_RUNS))
    return rows.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cut(keep_text), _ddl(_OUT + [("kept", _BIN)] * keep_text))
