"""Writers. Files that are one by nature (a report, a feed) take small, aggregated input."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.resolve import numbered_rows


def sorted_csv(df: DataFrame, path: str, order: Sequence[str], single: bool = False) -> None:
    """CSV with a header in a global order: parts in order, or one file for small results."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def split_json(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in a folder for each value of a column; readers prune by it. Each task
    writes its own file of a value, so a value with many rows is not sent to one task."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def nested(df: DataFrame, key: str, items: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A document a key: its items as an ordered array of structs. A key's items meet in one
    row, so this is for keys with few of them."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(items))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], replace: bool = True) -> DataFrame:
    """Old rows with new ones put in; without ``replace`` only rows of unknown keys enter."""
    if replace:
        return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"))


def markdown_lines(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(place, line): a Markdown table, header and rule first, then the rows in order. Null is
    an empty cell; a bar inside a cell is escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")) for c in df.columns]
    rows = numbered_rows(df, order, "_place").select((F.col("_place") + 1).cast("long").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(df.columns) + " |"), (1, "| " + " | ".join(["---"] * len(df.columns)) + " |")]
    return df.sparkSession.createDataFrame(head, "place long, line string").unionByName(rows)


def markdown_table(df: DataFrame, order: Sequence[str], limit: int = 1000) -> str:
    """The table as one text, for an aggregated result; more than ``limit`` rows are an error
    (``markdown_lines`` writes any number)."""
    lines = markdown_lines(df, order).orderBy("place").limit(limit + 3).collect()
    if len(lines) > limit + 2:
        raise ValueError(f"more than {limit} rows: write markdown_lines to files instead")
    return "\n".join(r.line for r in lines)


def turtle(triples: DataFrame) -> Column:
    """A Turtle line of (s, p, o, kind): kind "iri", "lang:xx" or a datatype."""
    text = F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    kind = F.col("kind")
    obj = F.when(kind == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).when(kind.startswith("lang:"), F.concat(quoted, F.lit("@"), F.substring(kind, 6, 20)))
    obj = obj.when(kind == "string", quoted).otherwise(F.concat(quoted, F.lit("^^xsd:"), kind))
    return F.concat(F.lit("<"), F.col("s"), F.lit("> "), F.col("p"), F.lit(" "), obj, F.lit(" ."))


def write_turtle(triples: DataFrame, path: str) -> None:
    triples.select(turtle(triples).alias("value")).write.mode("overwrite").text(path)


def feed(df: DataFrame, order: Sequence[Column], n: int = 100) -> DataFrame:
    """The newest n entries, as a feed lists them."""
    return df.orderBy(*order).limit(n)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def corpus_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash of a table's content, whatever its order: a key for cached results. Row hashes
    are added up, so no row order and no gathering is needed."""
    h = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*"), F.coalesce(F.sum(h), F.lit(0))).cast("binary"), 256).alias("key"))


def replaced(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Delete, then insert: all old rows of a key that has new rows go, and every new row
    enters, so that a key may have several."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def updated(old: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of known keys set to the values of ``changes`` (null included); unknown keys do
    not enter. ``changes`` has a key once."""
    new = changes.select(*key, F.struct(*columns).alias("_new"))
    both = old.join(new, list(key), "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def write_files(files: DataFrame, folder: str) -> None:
    """Writes each (name, content binary) row as a file of a shared folder, from its task. A
    file appears by a rename when it is whole, so a task that runs again does no harm."""
    from rollcall.sources.formats import opened

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for part in parts:
            for name, content in part[["name", "content"]].itertuples(index=False):
                work = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(work) as f:
                    f.write(content)
                store.move(work, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(part)]})

    files.mapInPandas(run, "n long").agg(F.sum("n")).collect()
