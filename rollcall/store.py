"""Results by content: what was worked out once from the same input is read, not made again.

An entry is a folder named by a hash of the inputs' rows (in any order), their schemas, the
parameters and a version. It is written beside the store and appears by one rename, so readers
see all of it or nothing, and of two that make the same entry one wins and both read it. A
changed row, parameter or version is another entry; nothing is ever overwritten.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import shared_folder


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order, and of the schema. Two 64-bit hashes of each
    row are added up, so one pass with one row a task is enough. Maps are hashed as JSON."""
    columns = [F.to_json(f.name) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema]
    # a null hashes to what came before it, so that it stands there is hashed too
    told: list[Column] = [x for c in columns for x in (c.isNull(), c)]
    one, two = (F.sum(F.xxhash64(F.lit(seed), *told).cast("decimal(38,0)")) for seed in ("a", "b"))
    n, a, b = df.agg(F.count("*"), one, two).first()
    return hashlib.sha256(f"{n} {a} {b} {df.schema.json()}".encode()).hexdigest()


class Store:
    """Entries under ``root``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or f"{shared_folder(spark)}/results").rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.conf)

    def key(self, inputs: dict[str, DataFrame], params: dict | None = None, version: str = "1") -> str:
        told = {"inputs": {k: content_hash(v) for k, v in inputs.items()}, "params": params or {}, "version": version}
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def has(self, name: str, key: str) -> bool:
        return self._files().exists(self._path(f"{self.root}/{name}/{key}"))

    def publish(self, name: str, key: str, made: DataFrame) -> bool:
        """Writes an entry; False if it was there first, or another writer was faster."""
        work, final = f"{self.root}/_work/{uuid.uuid4().hex}", f"{self.root}/{name}/{key}"
        made.write.parquet(work)
        files, fs = self._files(), self.jvm.org.apache.hadoop.fs
        files.mkdirs(self._path(f"{self.root}/{name}"))
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:  # unlike a plain rename this one fails where the target exists
            context = fs.FileContext.getFileContext(files.getUri(), self.conf)
            context.rename(files.makeQualified(self._path(work)), files.makeQualified(self._path(final)), none)
            return True
        except Py4JJavaError:
            if not self.has(name, key):
                raise
            files.delete(self._path(work), True)
            return False

    def replace(self, name: str, key: str, made: DataFrame) -> None:
        """Puts other rows in an entry, for a caller that keeps its meaning (a compaction)."""
        held = self._path(f"{self.root}/_work/{uuid.uuid4().hex}")
        made.write.parquet(str(held))
        self._files().delete(self._path(f"{self.root}/{name}/{key}"), True)
        self._files().rename(held, self._path(f"{self.root}/{name}/{key}"))

    def read(self, name: str, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{key}")

    def get(self, name: str, inputs: dict[str, DataFrame], make: Callable[..., DataFrame], params: dict | None = None, version: str = "1") -> DataFrame:
        """``make(**inputs, **params)``, worked out only if no entry has its key. Change
        ``version`` with the code of ``make``. What fails or is cut short leaves no entry."""
        key = self.key(inputs, params, version)
        if not self.has(name, key):
            self.publish(name, key, make(**inputs, **(params or {})))
        return self.read(name, key)

    def entries(self) -> list[tuple[str, str, int]]:
        """(name, key, time of publication in milliseconds) of what is stored, oldest first."""
        files, out = self._files(), []
        if not files.exists(self._path(self.root)):
            return []
        for folder in files.listStatus(self._path(self.root)):
            if folder.getPath().getName() != "_work":
                out += [(folder.getPath().getName(), e.getPath().getName(), e.getModificationTime()) for e in files.listStatus(folder.getPath())]
        return sorted(out, key=lambda e: (e[2], e))

    def forget(self, name: str, keep: int = 0) -> int:
        """Deletes all but the ``keep`` newest entries of a name; how many went. A job that
        still reads one of them fails, so keep those in use."""
        mine = [e for e in self.entries() if e[0] == name]
        old = mine[: max(0, len(mine) - keep)]
        for _, key, _ in old:
            self._files().delete(self._path(f"{self.root}/{name}/{key}"), True)
        return len(old)
