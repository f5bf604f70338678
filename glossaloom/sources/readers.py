"""Readers of text tables, file texts and metadata."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .archives import ROWS, ZipRecords, records
from .files import by_header, csv_header, escaped, first_record, lines, listed, retried, unescaped
from .pdf import pdf_text

STEM = r"([^/]*?)(?:\.[^./]*)?$"


def _strings(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def _plain_path() -> Column:
    """The path of a row's file; paths are given as in addresses."""
    return F.url_decode(F.replace(F.parse_url(F.col("_metadata.file_path"), F.lit("PATH")), F.lit("+"), F.lit("%2B")))


def _with_parent(rows: DataFrame, fields: Sequence[str], parent: bool) -> DataFrame:
    return rows.select(*([F.regexp_extract(_plain_path(), STEM, 1).alias("parent")] if parent else []), *(F.col(f"`{f}`") for f in fields))


def _csv_groups(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], delimiter: str, encoding: str, recursive: bool = False, pattern: str = "*") -> dict[tuple[str, ...], list[str]]:
    """CSV files by their header; each must have all fields."""
    groups = by_header(spark, listed(spark, paths, recursive=recursive, pattern=pattern), delimiter, encoding)
    for header, files in groups.items():
        if lost := [f for f in fields if f not in header]:
            raise ValueError(f"no column {lost[0]!r} in {files[0]}")
    return groups


def _all(frames: Sequence[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else empty


def read_csv(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], *, delimiter: str = ",", encoding: str = "UTF-8", parent: bool = False, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """Fields of CSV files with a header, as strings, picked by name in each file; ``parent`` is the file's stem.

    Files of one header are read together, so files may differ in their columns and the order of these. A file
    without one of the fields is an error, empty files have no rows.
    """
    groups = _csv_groups(spark, paths, fields, delimiter, encoding, recursive, pattern)
    options = {"header": True, "sep": delimiter, "encoding": encoding, "multiLine": True, "escape": '"', "maxCharsPerColumn": -1}
    read = [_with_parent(spark.read.options(**options).schema(_strings(header)).csv(files), fields, parent) for header, files in groups.items()]
    return _all(read, spark.createDataFrame([], _strings((["parent"] if parent else []) + list(fields))))


def read_xml(spark: SparkSession, paths: str, fields: Sequence[str], row_tag: str, *, parent: bool = False) -> DataFrame:
    """Fields of the records of XML files, as strings; tags are told without their namespaces."""
    return _with_parent(spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(_strings(fields)).load(paths), fields, parent)


def read_zip(spark: SparkSession, paths: str, fields: Sequence[str], *, kind: str = "csv", delimiter: str = ",", row_tag: str | None = None, parent: bool = False, by_member: bool = False) -> DataFrame:
    """Fields of all CSV or XML members of zip archives, by name; null where a record has none.

    ``by_member``: a task for each member, read as a stream (``archives.ZipRecords``; for paths that executors can open).
    Else a task reads the bytes of an archive through Spark's file systems, and its members one by one.
    """
    fields = list(fields)
    if by_member:
        spark.dataSource.register(ZipRecords)
        options = {"fields": json.dumps(fields), "kind": kind, "delimiter": delimiter} | ({"rowTag": row_tag} if row_tag else {}) | ({"parent": "parent"} if parent else {})
        return spark.read.format("zip_records").options(**options).load(paths)
    names = (["parent"] if parent else []) + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, content in zip(batch.column("stem"), batch.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for info in archive.infolist():
                        if info.is_dir():
                            continue
                        with archive.open(info) as member:
                            for rows in batched(records(member, kind, fields, delimiter, row_tag), ROWS):
                                columns = [[stem.as_py()] * len(rows)] if parent else []
                                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in [*columns, *zip(*rows, strict=True)]], names)

    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", STEM, 1).alias("stem"), "content")
    return files.mapInArrow(run, _strings(names))


def file_texts(spark: SparkSession, root: str, *, pattern: str = "*.txt", asked: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """(name, text) of the files below a folder; the name is their path from it.

    With ``asked``, a table of names, only those files are opened if they are ``most`` or fewer; if more, the others are left out by a join.
    """
    paths: str | list[str] = root.rstrip("/")
    if asked is not None:
        wanted = asked.select(F.btrim("name").alias("name")).distinct()
        names = [r.name for r in wanted.limit(most + 1).collect()]
        if len(names) <= most:
            there = set(names)
            files = [f for f in listed(spark, paths, recursive=True, pattern=pattern) if any(f.endswith(f"/{escaped(n)}") for n in _tails(unescaped(f)) & there)]
            if not files:
                return spark.createDataFrame([], "name string, text string")
            return _file_texts(spark, root, pattern, files).join(F.broadcast(wanted), "name", "left_semi")
        return _file_texts(spark, root, pattern, paths).join(wanted, "name", "left_semi")
    return _file_texts(spark, root, pattern, paths)


def _tails(path: str) -> set[str]:
    """The ends of a path, from each of its folders on."""
    parts = path.split("/")
    return {"/".join(parts[i:]) for i in range(1, len(parts))}


def _file_texts(spark: SparkSession, root: str, pattern: str, paths: str | list[str]) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths, wholetext=True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    return rows.select(F.substring(_plain_path(), len(folder) + 2, 1 << 30).alias("name"), F.col("value").alias("text"))


def join_file_texts(rows: DataFrame, texts: DataFrame, *, filename: str = "filename", folder: str | None = None, parent: str | None = None, separator: str = ";;") -> DataFrame:
    """Texts in place of the names of their files, several joined by a space in order.

    Names are paths from the root of ``texts``, below ``folder`` if it is given, or else below what the row's column
    ``parent`` says. Files that are missing are left out, and rows without any go. Rows may repeat.
    """
    name = F.btrim(F.col("name"))
    below = F.lit(folder) if folder is not None else F.col(f"row.{parent}") if parent is not None else F.lit(None).cast("string")
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), F.struct(*rows.columns).alias("row"), F.split(filename, separator).alias("names"))
    each = keyed.select("key", "row", F.posexplode("names").alias("pos", "name"))
    each = each.where(name != "").select("key", "row", "pos", F.concat_ws("/", F.when(below != "", F.btrim(below, F.lit("/"))), name).alias("name"))
    met = each.join(texts.select("name", F.col("text").alias("found")), "name").groupBy("key").agg(F.first("row").alias("row"), F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["found"]), " ").alias("text")
    return met.select(*(F.col("row").getField(c).alias(c) for c in rows.columns if c not in (filename, "text")), joined)


def read_metadata(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], id: str) -> DataFrame:
    """Metadata in latin-1 with inferred types, lower-case names and ``id``; columns are picked by name in each file.

    Types are those that all files agree on: whole numbers and others are doubles, and what is a number in some files only is text.
    """
    groups = _csv_groups(spark, paths, columns, ",", "ISO-8859-1")
    reader = lambda: spark.read.options(header=True, encoding="ISO-8859-1", multiLine=True, escape='"', maxCharsPerColumn=-1)
    types: dict[str, set[str]] = {c: set() for c in columns}
    for files in groups.values():
        for name, kind in reader().option("inferSchema", True).csv(files).select(*(F.col(f"`{c}`") for c in columns)).dtypes:
            types[name].add(kind)
    numbers = {"int", "bigint", "double"}
    agreed = {c: kinds.copy().pop() if len(kinds) == 1 else "string" if not kinds <= numbers else "double" if "double" in kinds else "bigint" for c, kinds in types.items()}
    read = []
    for header, files in groups.items():
        schema = ", ".join(f"`{c}` {agreed.get(c, 'string')}" for c in header)
        read.append(reader().schema(schema).csv(files).select(*(F.col(f"`{c}`") for c in columns)))
    rows = _all(read, spark.createDataFrame([], _strings(columns)))
    return rows.withColumnsRenamed({c: "id" if c == id else c.lower() for c in columns})


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, megabytes) of files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.round(F.col("length") / 1024 / 1024, 2).alias("megabytes"))


def header(spark: SparkSession, path: str, *, kind: str = "csv", row_tag: str | None = None, delimiter: str = ",") -> list[str]:
    """Field names of an input: a CSV's first record, the tags of the first XML record, or those of a zip archive's first member."""
    if kind == "csv":
        return list(csv_header(spark, listed(spark, path)[0], delimiter))
    if kind == "xml":
        return first_record(lines(spark, listed(spark, path)[0]), row_tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    info = next(m for m in archive.infolist() if not m.is_dir())
                    with archive.open(info) as member:
                        start = member.peek(64)
                        if start.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"<"):
                            names = first_record(iter(lambda: member.read(1 << 16), b""), row_tag)
                        else:
                            names = next(csv.reader(io.TextIOWrapper(member, "utf-8-sig", newline=""), delimiter=delimiter))
                yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], ["names"])

    first = listed(spark, path)[0]
    return spark.read.format("binaryFile").load(first).select("content").mapInArrow(run, "names array<string>").first()["names"]


def read_extracts(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, *, full: bool = True) -> DataFrame:
    """Extracts or datasets of several files, one after the other by column name; CSV by its ending, Parquet otherwise.

    Without ``full``, files of already tagged rows, which have "full" in their path, are left out.
    """
    chosen = [p for p in paths if full or "full" not in p]
    if not chosen:
        raise ValueError("no files are left to read")
    frames = [spark.read.csv(p, header=True, multiLine=True, escape='"') if p.endswith(".csv") else spark.read.parquet(p) for p in chosen]
    frames = [f.select(*(c for c in columns if c in f.columns)) if columns else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_documents(spark: SparkSession, paths: str, extractor: Callable[[bytes], str | None] = pdf_text, *, retries: int = 3) -> DataFrame:
    """(path, text) of PDF files, or of other binary documents by a given extractor; it is tried again on RuntimeError. Those without text go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [retried(extractor, content, retries) for content in batch["content"]]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, text string").where(F.col("text").isNotNull())


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str, fields: Sequence[str]) -> DataFrame:
    """Fields of a document collection; needs the connector on the class path."""
    return spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection).load().select(*fields)


def read_table(spark: SparkSession, name: str, limit: int | None = None, **jdbc: str) -> DataFrame:
    """A stored dataset, or a table over JDBC."""
    rows = spark.read.format("jdbc").options(dbtable=name, **jdbc).load() if jdbc else spark.table(name)
    return rows if limit is None else rows.limit(limit)
