"""Writers of extracts, training rows, datasets and samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.dataset import TYPES
from ..operators.extract import to_text
from .archives import ZipRecords, opened
from .shared import new_folder

ROWS_PER_FILE = 1_000_000


def write_extracts(extracts: DataFrame, path: str, *, kind: str = "parquet", by: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Extracts as Parquet with arrays, or as CSV with chunks joined by ``|``; by source if asked."""
    rows = extracts if kind == "parquet" else to_text(extracts)
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("header", "true")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def write_csv(rows: DataFrame, path: str, *, first: Sequence[str] = ()) -> None:
    """Rows as CSV, some columns first. Space around texts stays."""
    rest = [c for c in rows.columns if c not in first]
    rows.select(*first, *rest).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_zip(rows: DataFrame, path: str) -> None:
    """Rows as zipped CSV, an archive for each task; the path must be one that executors can open."""
    rows.sparkSession.dataSource.register(ZipRecords)
    strings = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    strings.write.format("zip_records").mode("overwrite").option("fields", "[]").save(path)


def create_table(rows: DataFrame, name: str, types: Mapping[str, str], tags: Sequence[str]) -> None:
    """Replace a table by one with declared columns and the rows; the old one stays until the new one is whole."""
    columns = [f"`{c}` {TYPES[kind]}" for c, kind in types.items()] + [f"`{t.lower()}` int not null" for t in tags]
    spark = rows.sparkSession
    new = f"{name}__new"
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    spark.sql(f"CREATE TABLE {new} ({', '.join(columns)}) USING parquet")
    append_table(rows, new)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")


def append_table(rows: DataFrame, name: str) -> None:
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).write.mode("append").insertInto(name)


def table_exists(rows: DataFrame, name: str) -> bool:
    return rows.sparkSession.catalog.tableExists(name)


def write_text_files(rows: DataFrame, path: str, *, name: str = "name", text: str = "text") -> DataFrame:
    """Write one ``.txt`` file for each row, spaces of its name as ``_``, and give (name, bytes) of what was written.

    Files are written under another name first, so none is ever half there; a task that runs again writes the same. The
    path must be one that executors can open. Names may have folders; a null text is an empty file.
    """
    system, root = opened(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        for batch in batches:
            names, sizes = [], []
            for n, t in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, data = f"{root}/{n}.txt", (t or "").encode()
                system.create_dir(at.rpartition("/")[0], recursive=True)
                held = f"{at}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(held) as out:
                    out.write(data)
                system.move(held, at)
                names.append(n)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    system.create_dir(root, recursive=True)
    told = rows.select(F.replace(F.col(name), F.lit(" "), F.lit("_")).alias("name"), F.col(text).cast("string").alias("text")).where("name is not null")
    return written(told.mapInArrow(run, "name string, bytes long"), new_folder(rows.sparkSession, "texts"))


def written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written as Parquet, so that they are computed now and once, and read back."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_texts(rows: DataFrame, path: str, *, name: str = "name", text: str = "text") -> None:
    """One folder of text for each name, spaces in it as ``_``."""
    rows.select(F.replace(F.col(name), F.lit(" "), F.lit("_")).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
