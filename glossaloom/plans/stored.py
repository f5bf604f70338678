"""Registered queries of readers, writers and stored datasets: rows of the given tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources import readers, sinks
from ..sources.shared import new_folder
from ..sources.stored import StoredDataset
from .catalogue import RULES_A, Query, _docs, _extracts, _sql_extract, _sql_tags, _table, registrar

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

@query("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, source, text FROM documents")
def csv_round_trip(spark, sf):
    """Two exports whose columns stand in different orders, read together by name."""
    docs, at = _docs(spark, sf), new_folder(spark, "csv")
    sinks.write_csv(docs.where("text < 'm'"), f"{at}/a", first=["text", "source"])
    sinks.write_csv(docs.where("text >= 'm' OR text IS NULL").withColumn("more", F.lit("x")), f"{at}/b", first=["source", "more", "doc_id"])
    return readers.read_csv(spark, f"{at}/*", ["doc_id", "source", "text"], pattern="*.csv")


@query("xml_round_trip", "SELECT doc_id::VARCHAR AS doc_id, source, lang FROM documents")
def xml_round_trip(spark, sf):
    """Records of an XML export; tags that are not asked for are passed over."""
    at = new_folder(spark, "xml")
    _table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").write.format("xml").option("rowTag", "doc").option("rootTag", "docs").save(at)
    return readers.read_xml(spark, at, ["doc_id", "source", "lang"], "doc")


@query("zip_round_trip", "SELECT doc_id::VARCHAR AS doc_id, source, text FROM documents")
def zip_round_trip(spark, sf):
    """Zipped CSV, an archive for each task that writes and a task for each member that reads."""
    at = new_folder(spark, "zip")
    sinks.write_zip(_docs(spark, sf), at)
    return readers.read_zip(spark, at, ["doc_id", "source", "text"], by_member=True)


@query("text_files_round_trip", "SELECT page_id::VARCHAR AS name, html AS text, octet_length(encode(html)) AS bytes FROM pages WHERE html IS NOT NULL")
def text_files_round_trip(spark, sf):
    """A file for each page, found again by its path."""
    at = new_folder(spark, "files")
    pages = _table(spark, sf, "pages").where("html IS NOT NULL").select(F.concat(F.col("page_id") % 7, F.lit("/"), "page_id").alias("name"), "html")
    told = sinks.write_text_files(pages, at, text="html")
    texts = readers.file_texts(spark, at).select(F.regexp_replace("name", r"\.txt$", "").alias("name"), "text")
    return texts.join(told, "name").select(F.substring_index("name", "/", -1).alias("name"), "text", "bytes")


@query("stored_dataset", f"WITH {_sql_extract()} SELECT doc_id, source, {_sql_tags(RULES_A)} FROM e")
def stored_dataset(spark, sf):
    """Tagged rows stored in two batches, the second sent twice."""
    tagged = rules.apply_rules(_extracts(spark, sf), RULES_A).drop("chunks")
    stored = StoredDataset(spark, new_folder(spark, "dataset"))
    stored.create(tagged.where("linking = 1"), "linking")
    for _ in range(2):
        stored.append(tagged.where("linking = 0"), "others")
    return stored.read()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
