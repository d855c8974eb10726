"""From raw documents to packed training sequences, one written table after another.

Language ID drops what it cannot place; exact and near-duplicate dedup keep one document of
each group; the secret scan masks what it finds; packing turns the rest into sequences.

In every stage a null text counts as empty, texts are read whole, repeated rows are judged each
by its own text, an empty table gives an empty result, and columns that a stage does not need
pass through as they are, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import exact, langid, nearcopies, packing, secrets
from rollcall.llm.common import documents, prepare

#: Below this calibrated probability a text's language counts as unknown.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and those below MIN_SCORE; fills a missing
    ``lang``. Where no row can be learned from, only the first two go."""
    return langid.accepted(docs, MIN_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the smallest doc_id (a row
    without one comes last); of rows that tie in both, one. Null and empty texts are equal."""
    return exact.first_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five words the smallest doc_id stays (a row
    without one comes last). Texts of fewer words are one shingle; those of none are alike."""
    return nearcopies.first_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked; a null text stays null."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences; a null or empty text is one id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]

#: SQL can express neither a trained classifier nor tokenising.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    root = f"{prepare(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
