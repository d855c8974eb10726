"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at hits, checksums.

One automaton pass over a text finds the literal every kind starts with; only there is the
kind's expression tried, anchored at the hit. Hex runs have no literal, so their keyword is
24 characters of the class, searched in a class-mapped copy. Kinds with an embedded checksum
(GitHub, npm and Grafana tokens) count only if the checksum holds.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import prepare

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "grafana")
RANK = {k: i for i, k in enumerate(KINDS)}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
GRAFANA = re.compile(r"(glsa_[0-9A-Za-z]{32})_([0-9a-f]{8})(?![0-9a-f])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 24


def base62_crc(body: str) -> str:
    """CRC-32 of the random part, in base 62 of six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


def _crc62(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _crc_hex(m: re.Match) -> bool:
    return struct.pack("<I", zlib.crc32(m[1].encode())).hex() == m[2]


@dataclass(frozen=True)
class Kind:
    """``keep`` is judged after matching: a dropped match still uses up its characters."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    folded: bool
    keep: object


RULES = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, True, lambda m: len(m[2]) >= 6),
    Kind("access", ("akia",), ACCESS, False, lambda m: len(m[0]) >= 20),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), GITHUB, False, _crc62),
    Kind("npm", ("npm_",), NPM, False, _crc62),
    Kind("grafana", ("glsa_",), GRAFANA, False, _crc_hex),
)


def automaton() -> ahocorasick.Automaton:
    """Keywords are ASCII; the text is folded byte by byte, which keeps code points in place."""
    found: dict[str, list[int]] = {}
    for i, k in enumerate(RULES):
        for w in k.keywords:
            found.setdefault(w, []).append(i)
    a = ahocorasick.Automaton()
    for w, rules in found.items():
        a.add_word(w, (len(w), tuple(rules)))
    a.make_automaton()
    return a


_HEX_CLASS = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least HEX_RUN characters of 0-9a-f, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    mapped, out, at = raw.translate(_HEX_CLASS), [], 0
    need = b"h" * HEX_RUN
    while (a := mapped.find(need, at)) >= 0:
        b = mapped.find(b" ", a)
        b = len(mapped) if b < 0 else b
        out.append((a, b))
        at = b
    if out and len(raw) != len(text):
        points, seen = [], (0, 0)
        for a, b in out:
            start = seen[1] + len(raw[seen[0]:a].decode("utf-8", "surrogatepass"))
            points.append((start, start + b - a))
            seen = (b, start + b - a)
        return points
    return out


def scan(text: str | None, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as listed."""
    if not text:
        return []
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    ends, spans = [0] * len(RULES), []
    hits = sorted((end - size + 1, rules) for end, (size, rules) in auto.iter(folded))
    for start, rules in hits:
        for i in rules:
            rule = RULES[i]
            if start >= ends[i] and (m := rule.pattern.match(text, start)):
                ends[i] = m.end()
                if rule.keep(m):
                    spans.append((rule.name, m.start(), m.end()))
    spans += [("hex", a, b) for a, b in _hex_runs(text)]
    return sorted(spans, key=lambda s: (s[1], RANK[s[0]]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets array<struct<kind,start,end>>): one row per input row.

    Null and empty texts have no secret; very long texts are scanned whole; repeated rows
    each keep a row; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t.as_py(), auto)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "secrets"])

    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("secrets", SPANS)]))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every found span replaced by ``mark``; overlapping spans become one mark.

    A text without secrets is unchanged, null included; ``n_chars``, where there is one, is
    brought up to date. Every row stays.
    """
    schema, at = df.schema, df.columns.index(text_col)
    count = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def clean(text: str | None, auto: ahocorasick.Automaton) -> str | None:
        out, upto = [], 0
        for _, a, b in scan(text, auto):
            if a >= upto:
                out += [text[upto:a], mark]
            upto = max(upto, b)
        return "".join([*out, text[upto:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            old = b.column(at).to_pylist()
            new = [clean(t, auto) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if count is not None:
                sizes = [len(n) if n is not None and n != o else c for n, o, c in zip(new, old, b.column(count).to_pylist())]
                cols[count] = pa.array(sizes, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def report(df: DataFrame) -> DataFrame:
    """Digest columns of ``find_secrets`` over (doc_id, text)."""
    found = find_secrets(df)
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    of = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    many = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *many, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))

