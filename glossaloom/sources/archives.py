"""Zip archives of CSV or XML files, as a source of Spark: a task for each member, which is read as a stream.

``spark.dataSource.register(ZipRecords)`` once, then
``spark.read.format("zip_records").option("fields", '["id", "text"]').load(path)``. The paths must be within reach
of pyarrow's file systems (local and shared folders, S3, HDFS with its native library); ``readers.read_zip`` has another way for
stores that only Spark reaches.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from .files import local_name

ROWS = 2_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path on it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def records(member: io.BufferedIOBase, kind: str, fields: Sequence[str], delimiter: str = ",", row_tag: str | None = None) -> Iterator[list[str | None]]:
    """Values of the fields of each record, by name; null where a record has none. The member is read as a stream."""
    if kind == "csv":
        csv.field_size_limit(sys.maxsize)  # texts may be of any length
        text = io.TextIOWrapper(member, "utf-8-sig", newline="")
        for record in csv.DictReader(text, delimiter=delimiter):
            yield [record.get(f) for f in fields]
        return
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(member, ["start", "end"]):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if local_name(element.tag) == row_tag:
            record = {local_name(child.tag): child.text for child in element}
            yield [record.get(f) for f in fields]
            if above:  # what was told is let go, or a long file would stay in memory
                above[-1].remove(element)


class Member(InputPartition):
    def __init__(self, path: str, name: str, stem: str):
        self.path, self.name, self.stem = path, name, stem


class ZipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.options = options
        self.kind = options.get("kind", "csv")

    def _archives(self) -> list[str]:
        path = self.options["path"]
        system, at = opened(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.File:
            return [at]
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))

    def partitions(self) -> list[Member]:
        """A task for each member; only the archives' directories are read here."""
        system, _ = opened(self.options["path"])
        out = []
        for at in self._archives():
            with system.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
                out += [Member(at, m.filename, at.rpartition("/")[2].rpartition(".")[0]) for m in archive.infolist() if not m.is_dir()]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.options["path"])
        parent = self.options.get("parent")
        fields = [n for n in self.names if n != parent]
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
            held: list[list] = []
            for row in records(member, self.kind, fields, self.options.get("delimiter", ","), self.options.get("rowtag")):
                held.append(row)
                if len(held) == ROWS:
                    yield self._batch(held, fields, parent, partition)
                    held = []
            yield self._batch(held, fields, parent, partition)

    def _batch(self, rows: list[list], fields: Sequence[str], parent: str | None, partition: Member) -> pa.RecordBatch:
        columns = dict(zip(fields, zip(*rows, strict=True), strict=True)) if rows else {f: () for f in fields}
        if parent:
            columns[parent] = [partition.stem] * len(rows)
        return pa.RecordBatch.from_pydict({n: pa.array(columns[n], pa.string()) for n in self.names})


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class ZipWriter(DataSourceArrowWriter):
    """Each task writes one archive of one CSV file, under a name that readers pass over until all are written."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.options, self.overwrite = schema.fieldNames(), options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.options["path"])
        system.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        path, rows = f"{at}/{name}.tmp", 0
        with system.open_output_stream(path) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(f"{name}.csv", "w", force_zip64=True) as member:
            text = io.TextIOWrapper(member, "utf-8", newline="", write_through=True)
            out = csv.writer(text)
            out.writerow(self.names)
            for batch in batches:
                out.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                rows += batch.num_rows
            text.flush()
            text.detach()
        return Written(path if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.options["path"])
        new = {m.path for m in messages if m is not None and m.path}
        old = [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path not in new]
        for path in new:
            system.move(path, f"{path.removesuffix('.tmp')}.zip")
        for path in old if self.overwrite else ():
            if path.endswith((".zip", ".tmp")):
                system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.options["path"])
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class ZipRecords(DataSource):
    """Options: ``fields`` (a JSON list; only these are kept), ``kind`` csv or xml, ``delimiter``, ``rowTag``, ``parent`` (a column for the archive's stem)."""

    @classmethod
    def name(cls) -> str:
        return "zip_records"

    def schema(self) -> StructType:
        parent = self.options.get("parent")
        return StructType([StructField(n, StringType()) for n in ([parent] if parent else []) + json.loads(self.options["fields"])])

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(schema, dict(self.options), overwrite)
