"""A session with the settings the operators are planned for."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, ANSI casts. On a cluster leave ``master`` unset; adaptive
    execution then coalesces the shuffle partitions to the data at hand."""
    b = SparkSession.builder.appName("rollcall")
    if master:
        b = b.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
             "spark.sql.ansi.enabled": "true", "spark.ui.showConsoleProgress": "false",
             "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=fixed | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if it is not: the one that ``spark.checkpoint.dir`` names. A
    folder of this machine serves only where all work is on it; on a cluster it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rollcall-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the checkpoint folder: what follows may read them
    twice and, after a lost executor, again, and always sees the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that are saved by now: between
    steps of a long job, so that they need not all lie on the disks at once. What Python gives
    up in the first round the JVM can drop in the second; the cleaner has its own thread."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python some at a time, by rows and by bytes, so that a worker holds little
    of a table of long texts. Both stay set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
