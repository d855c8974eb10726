"""The queries op1 to op13 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm.common import documents, prepare
from rollcall.llm.exact import ORACLE as EXACT_SQL
from rollcall.llm.hamming import ORACLE as HAMMING_SQL
from rollcall.llm.merkle import ORACLE as MERKLE_SQL
from rollcall.llm.mixing import ORACLE as MIXING_SQL
from rollcall.llm.negatives import ORACLE as NEGATIVES_SQL


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.secrets import report

    return report(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.langid import identify

    return identify(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rollcall.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over instruction data, where all three limits count."""
    import public_tokenizers

    from rollcall.llm.packing import pack_conversations

    return pack_conversations(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.hamming import search_embeddings

    return search_embeddings(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.exact import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rollcall.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.sentences import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.sharding import report

    return report(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.suffix import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.mixing import report

    return report(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.negatives import report

    return report(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.merkle import report

    return report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_secret_scan, op3_language_id, op4_packing, op5_hamming_top_k,
                                  op6_exact_dedup, op7_byte_bpe, op8_sentence_spans, op9_sharding, op10_suffix_dedup, op11_source_mix, op12_hard_negatives, op13_merkle_manifest, pipeline, instruction_packing)}
ORACLE_SQL: dict[str, str] = {"op5_hamming_top_k": HAMMING_SQL, "op6_exact_dedup": EXACT_SQL, "op11_source_mix": MIXING_SQL, "op12_hard_negatives": NEGATIVES_SQL,
                             "op13_merkle_manifest": MERKLE_SQL}
