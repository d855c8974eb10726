"""Readers."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: Sequence[str] = TABLES) -> None:
    """Temporary views, for SQL over the same tables."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column where there is one, else a null of its type."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def csv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """Header, explicit schema, byte-order mark tolerated; short rows are filled with nulls,
    lines that start with ``comment`` and blank ones are left out."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def markdown_csv(texts: DataFrame, text: str, name: str, schema: str) -> DataFrame:
    """Rows of the fenced CSV block under the heading "### name"; none where it is missing.
    The header gives the order of columns; quoted line ends are not supported."""
    block = F.regexp_extract(F.col(text), rf"(?s)###\s+{name}\s*?\n.*?```csv\s*?\n(.*?)```", 1)
    lines = texts.select(F.filter(F.split(block, r"\r?\n"), lambda x: F.trim(x) != "").alias("l")).where(F.size("l") > 1)
    rows = lines.select(F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("row"))
    return rows.select(F.from_csv("row", F.lit(schema), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def unwrapped(text: str, schema: str) -> Column:
    """JSON between "const X =" and ";"."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"^\s*(?:const|var|let)\s+\w+\s*=\s*", ""), r";\s*$", "")
    return F.from_json(body, schema)


def fenced_jsonl(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """Lines of a fenced block as JSON; // comments and blanks are left out, and bad lines
    come back with all columns null and the line in ``_bad``."""
    block = F.regexp_extract(F.col(text), r"(?s)```jsonl?\s*?\n(.*?)```", 1)
    lines = texts.select(F.explode(F.split(block, r"\r?\n")).alias("line")).where("trim(line) <> '' and not startswith(trim(line), '//')")
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r")).select("r.*")


def json_new(spark: SparkSession, path: str, schema: str, key: str, existing: DataFrame) -> DataFrame:
    """Elements of the JSON arrays in a folder whose key is not there yet, once each."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


#: Elements that end a line (fixed values).
BLOCKS = ("br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ol", "p", "td", "tr", "ul")


class _Text(HTMLParser):
    """Collects text; a block tag ends the line unless it is empty or has just ended."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text = io.StringIO()
        self.last = "\n"  # no line end before the first text

    def end_line(self, tag: str) -> None:
        if tag in BLOCKS and self.last != "\n":
            self.handle_data("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_line(tag)

    handle_endtag = end_line

    def handle_data(self, data: str) -> None:
        self.text.write(data)
        self.last = data[-1:] or self.last


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of a page: a block tag ends the line once, other white space stays as it is."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        return p.text.getvalue()

    return s.map(one)


def html_text_plain(c: Column) -> Column:
    """The same by expressions alone, for pages without comments, scripts or broken tags."""
    mark = "\u0001"
    t = F.regexp_replace(c, r"(?i)</?(?:" + "|".join(BLOCKS) + r")(?:\s[^>]*)?/?>", mark)
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, f"^{mark}+", ""), f"\n{mark}+", "\n")
    return F.regexp_replace(t, f"{mark}+", "\n")


def updated_on(c: Column) -> Column:
    """Date of "last updated (d.m.yyyy)" in a text."""
    d = [F.regexp_extract(F.lower(c), r"(?:last updated|обновлено)[^0-9]{0,20}(\d{1,2})\.(\d{1,2})\.(\d{4})", i) for i in (1, 2, 3)]
    return F.try_to_date(F.when(d[0] != "", F.concat_ws("-", d[2], F.lpad(d[1], 2, "0"), F.lpad(d[0], 2, "0"))))


def preferred(key: str, *parts: DataFrame) -> DataFrame:
    """(key, text, source): text of the first table that has one, with its number."""
    out, found = parts[0].select(key), []
    for p in parts[1:]:
        out = out.unionByName(p.select(key))
    out = out.distinct()
    for i, p in enumerate(parts):
        out = out.join(p.select(key, F.col("text").alias(f"_t{i}")), key, "left")
        found.append(F.when(F.trim(f"_t{i}") != "", F.struct(F.col(f"_t{i}").alias("text"), F.lit(i).alias("source"))))
    return out.withColumn("_f", F.coalesce(*found)).select(key, "_f.text", "_f.source")


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Seed rows and rule tables."""
    return spark.createDataFrame(rows, schema)


def pdf_text(files: DataFrame) -> DataFrame:
    """(path, text) of a ``binaryFile`` table: the pages' texts, one line end between them.

    Needs the optional library pypdf on the workers; without it, and for files that are no
    PDF, the text is null, so that a next source can stand in (see ``preferred``).
    """

    @F.pandas_udf(T.StringType())
    def run(contents: pd.Series) -> pd.Series:
        try:
            from pypdf import PdfReader
        except ImportError:
            return pd.Series([None] * len(contents), dtype="object")

        def one(data: bytes | None) -> str | None:
            try:
                return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
            except Exception:  # a broken file must not end the job
                return None

        return contents.map(one)

    return files.select("path", run("content").alias("text"))


def sqlite_rows(files: DataFrame, statement: str, schema: str, batch: int = 10_000) -> DataFrame:
    """Rows that a SQL statement gives in each SQLite database of a ``binaryFile`` table.

    A task opens the file's bytes in memory, so files may lie in any store Spark reads, and
    many files are read in parallel; a file has to fit a worker. A file that is no database
    ends the job. Columns follow ``schema`` by place.
    """
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                found = db.execute(statement)
                while rows := found.fetchmany(batch):
                    yield pd.DataFrame(rows, columns=names)
                db.close()

    return files.select("content").mapInPandas(run, schema)
