"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Three passes. Document frequencies of hashed n-grams and the counts of languages come from
all labelled rows that may be learned from. Weights are learned from a bounded sample of
them, PER_LANGUAGE rows of each of MOST_LANGUAGES languages at most, by follow-the-regularised-leader
(FTRL-proximal), whose L1 part leaves most weights zero; a temperature is then fitted on a
part of the sample that the weights have not seen. Last, every text is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import prepare

BUCKET_BITS, GRAMS, PER_LANGUAGE, EPOCHS = 15, 3, 1500, 4
#: Languages that one model tells apart at most; its weights fit a worker.
MOST_LANGUAGES = 200
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
FOLDS = 5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the letters of a text and their counts; None without a letter.

    Letters are lower-cased; runs of anything else are one blank, as are both ends.
    """
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, 32).astype(np.uint32)
    code = np.concatenate(([32], code, [32])).astype(np.uint32)
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    h, size = code, len(code)
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for n in range(1, min(GRAMS, size) + 1):
        h = code if n == 1 else h[:-1] * np.uint32(0x01000193) + code[n - 1:]
        bucket = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)
        counts += np.bincount(bucket, minlength=len(counts))
    at = np.flatnonzero(counts)
    return at, counts[at]


def _tf_idf(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(found[1])) * idf[found[0]]
    return x / np.linalg.norm(x)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """FTRL-proximal with elastic-net penalties, one weight vector a class."""

    def __init__(self, classes: int) -> None:
        self.z = np.zeros((1 << BUCKET_BITS, classes))
        self.n = np.zeros_like(self.z)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, r = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def _rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("fold"))


def _document_frequencies(rows: DataFrame) -> np.ndarray:
    """Of all rows given, with their number last. The driver gets a number a hash bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if (found := grams(t.as_py())) is not None:
                    df[found[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["bucket", "df"])

    counts = rows.select("text").mapInArrow(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df")).toPandas().to_numpy()
    out = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    out[counts[:, 0]] = counts[:, 1]  # the number of documents is last, at -1
    return out


def _sample(rows: DataFrame, per_language: int, most: int) -> tuple[list[str], DataFrame]:
    """Languages to learn, and for each of them at most ``per_language`` rows that differ in
    id or text, those of smallest hash. Rows that repeat count once, however many they are."""
    keyed = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    sizes = keyed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("_h").alias("unlike"))
    found = {r.lang: r.unlike for r in sizes.orderBy(F.col("n").desc(), "lang").limit(most).collect()}
    if not found:
        return [], rows.limit(0)
    # a threshold on the hash leaves few rows too many, which only then are ranked
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in found.items() for v in (k, min(1.0, 1.3 * per_language / max(n, 1)))]), F.col("lang"))
    few = keyed.where(F.col("lang").isin(*found)).where(F.col("_h") / F.lit(float(1 << 63)) <= share)
    few = few.groupBy("lang", "_h", "doc_id", "fold", "text").agg(F.count("*").alias("_n"))
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))).where(F.col("_r") <= per_language)
    return sorted(found), ranked.select("doc_id", "text", "lang", F.col("fold").cast("long").alias("fold"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> dict:
    """A model from the rows outside fold 0 that have a text, an id and a language.

    The frequencies see all rows, the weights at most ``per_language`` different rows of each
    language. Fold 1 of the sample fits the temperature; it stays 1 if the sample has none in
    that fold, or no other, which then is learned from. Of more than ``most`` languages those
    with the most rows are learned, ties by name. A sample without a letter is no sample: then,
    as without a labelled row, the model knows no language.
    """
    prepare(df.sparkSession)
    rows = _rows(df, id_col, text_col, lang_col).where("fold <> 0 and text is not null and lang is not null")
    freq = _document_frequencies(rows)
    idf = np.log((1 + freq[-1]) / (1 + freq[:-1])) + 1
    names, sample = _sample(rows, per_language, most)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(names)}
        seen = []
        for b in batches:
            for i, t, k, part in zip(*(c.to_pylist() for c in b.columns)):
                if (found := grams(t)) is not None:
                    seen.append((i, part, place[k], found[0], _tf_idf(found, idf).astype(np.float32), t))
        if not seen:
            return
        seen.sort(key=lambda s: (s[0], s[2], s[5]))
        model, order = Ftrl(len(names)), np.random.default_rng(7)
        learn = [s for s in seen if s[1] != 1]
        held = [s for s in seen if s[1] == 1] if learn else []
        learn = learn or seen
        for _ in range(EPOCHS):
            for j in order.permutation(len(learn)):
                model.learn(learn[j][3], learn[j][4], learn[j][2])
        w = model.weights(slice(None)).astype(np.float32)
        t = temperature(np.array([s[4] @ w[s[3]] for s in held]), np.array([s[2] for s in held], int))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["weights", "temperature"])

    # the scan stays spread over tasks; only the bounded sample meets in one
    made = sample.repartition(1).mapInArrow(train, "weights binary, temperature double").first() if names else None
    if made is None:
        return {"names": [], "idf": idf, "weights": np.zeros((1 << BUCKET_BITS, 0), np.float32), "temperature": 1.0}
    w = np.frombuffer(bytes(made["weights"]), np.float32).reshape(1 << BUCKET_BITS, len(names))
    return {"names": names, "idf": idf, "weights": w, "temperature": made["temperature"]}


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per input row, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [classify(t.as_py(), model) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def classify(text: str | None, model: dict) -> tuple[str, float]:
    """Language and calibrated probability; (UNKNOWN, 0) for a text without a letter or a
    model without a language. Ties go to the first language by name."""
    found = grams(text)
    if found is None or not model["names"]:
        return UNKNOWN, 0.0
    p = _softmax((_tf_idf(found, model["idf"]) @ model["weights"][found[0]]) / model["temperature"])
    i = int(p.argmax())
    return model["names"][i], float(p[i])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per input row.

    Null texts and texts without a letter are ``und`` with score 0; a row without an id is
    not held out and not learned from; rows that repeat are each predicted; texts are read
    whole; without any labelled row with a letter all are ``und``; an empty table gives an empty result.
    No column but the text has a part in a prediction.
    """
    model = fit(df, id_col, text_col, lang_col)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return predict(df, model, id_col, text_col).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(df: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose language is known with at least ``min_score``; a row
    without a language gets the predicted one.

    Null texts and texts without a letter go. Where nothing can be learned (no ``lang`` column,
    or no row with one outside fold 0) only these go, since no language can be told. Repeated
    rows are judged alike; an empty table stays empty; other columns are returned as they are.
    """
    prepare(df.sparkSession)
    schema, labelled = df.schema, "lang" in df.columns
    model = fit(df) if labelled else {"names": []}
    text, lang = df.columns.index("text"), df.columns.index("lang") if labelled else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not model["names"]:
                yield b.filter(pa.array([grams(t.as_py()) is not None for t in b.column(text)], pa.bool_()))
                continue
            made = [classify(t.as_py(), model) for t in b.column(text)]
            cols = list(b.columns)
            cols[lang] = pa.array([old if old is not None else m[0] for old, m in zip(b.column(lang).to_pylist(), made)], b.schema.field(lang).type)
            keep = pa.array([m[0] != UNKNOWN and m[1] >= min_score for m in made], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(keep)

    return df.mapInArrow(run, schema)
