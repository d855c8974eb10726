"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import release, shared_folder  # noqa: F401

#: Rows in an Arrow batch; a batch of the longest texts must still fit a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, which stay set for the session, and a checkpoint folder: the one
    that the cluster names; a folder of this machine only where all work is on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared_folder(spark)
    return spark


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, which outlives a lost executor."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` saved as a table bucketed by ``key`` in the checkpoint folder. Tasks write the
    buckets' files themselves, so nothing is shuffled; steps that group by the key find each
    bucket in one task and do not shuffle it either. The name in the catalog is only needed to
    open the files and is gone afterwards."""
    spark = prepare(df.sparkSession)
    name = f"rollcall_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column's name can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
