"""Sources for ``spark.read.format``: tables that sit inside other files.

``register_formats(spark)`` makes known ``markdown_csv``, ``fenced_jsonl``, ``wrapped_json``
and ``sqlite``. Each takes a file or a folder of any store that Arrow can open, and a schema.
Files are partitions; only the columns of the schema are taken out of them, by name, so a
narrower schema reads less; a column that a file lacks is null. Text formats hold one file in a
task's memory, as text; rows are handed on one by one.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import sqlite3
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Column that takes the text of a line that could not be read, where the schema has it.
BAD = "_bad"


class OneFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def converted(value: object, kind: str) -> object:
    """A text or JSON value as the type of its column; null where it is none of it."""
    if value is None:
        return None
    try:
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if kind in ("integer", "long", "short", "byte"):
            return int(value)
        if kind in ("double", "float"):
            return float(value)
        if kind == "boolean":
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
    except (TypeError, ValueError):
        return None
    raise ValueError(f"columns of type {kind} are not known here")


class Files(DataSourceReader):
    """A partition a file; what starts with a dot or an underscore, or is empty, is none."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("name a file or folder: load(path)")
        self.options, self.fields = options, [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.options["path"])
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        fit = sorted(x.path for x in found if x.is_file and x.size and not os.path.basename(x.path).startswith((".", "_")))
        return [OneFile(x) for x in fit]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        store, _ = opened(self.options["path"])
        for record in self.records(store, partition.path):
            yield tuple(converted(record.get(name), kind) for name, kind in self.fields)

    def text(self, store: fs.FileSystem, path: str) -> str:
        with store.open_input_stream(path) as f:
            return f.read().decode("utf-8-sig")

    def records(self, store: fs.FileSystem, path: str) -> Iterator[dict]:
        raise NotImplementedError


class MarkdownCsvReader(Files):
    def records(self, store, path):
        heading = re.escape(self.options.get("block", ""))
        for block in re.finditer(rf"^###\s+{heading}[ \t]*\r?\n(?:(?!###\s)[^\n]*\n)*?```csv[ \t]*\r?\n(.*?)^```", self.text(store, path), re.M | re.S):
            yield from csv.DictReader(io.StringIO(block[1]))


class FencedJsonlReader(Files):
    def records(self, store, path):
        inside = False
        for line in io.StringIO(self.text(store, path)):
            told = line.strip()
            if told.startswith("```"):
                inside = not inside and told in ("```json", "```jsonl")
            elif inside and told and not told.startswith("//"):
                try:
                    found = json.loads(told)
                except ValueError:
                    found = None
                yield found if isinstance(found, dict) else {BAD: told}


class WrappedJsonReader(Files):
    def records(self, store, path):
        text, read, at = self.text(store, path), json.JSONDecoder(), 0
        start = re.compile(r"^\s*(?:const|var|let)\s+\w+\s*=\s*", re.M)
        while head := start.search(text, at):
            found, at = read.raw_decode(text, head.end())
            yield from found if isinstance(found, list) else [found]


class SqliteReader(Files):
    def records(self, store, path):
        name = '"' + self.options.get("table", "").replace('"', '""') + '"'
        if isinstance(store, fs.LocalFileSystem):  # pages are read as they are needed
            db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        else:
            with store.open_input_stream(path) as f:
                db = sqlite3.connect(":memory:")
                db.deserialize(f.read())
        try:
            there = {c[1] for c in db.execute(f"pragma table_info({name})")}
            wanted = [n for n, _ in self.fields if n in there]
            listed = ", ".join('"' + n.replace('"', '""') + '"' for n in wanted) or "1"
            for row in db.execute(f"select {listed} from {name}"):
                yield dict(zip(wanted, row))
        finally:
            db.close()


def _source(format_name: str, reader_type: type[Files]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            raise ValueError(f"{format_name} needs a schema: spark.read.format(...).schema(...)")

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader_type(schema, dict(self.options))

    return Source


SOURCES = [_source(n, r) for n, r in (("markdown_csv", MarkdownCsvReader), ("fenced_jsonl", FencedJsonlReader), ("wrapped_json", WrappedJsonReader), ("sqlite", SqliteReader))]


def register_formats(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
