"""The corpus pipeline: from documents to token ids, in five stages.

Each stage reads what the stage before it kept, as Parquet, and its decisions
take effect: rejected documents go, repeated lines are cut out, one document
of each near-duplicate group stays, contaminated documents go, and the rest is
encoded. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossaloom.llm.decontaminate import decontaminate as find_benchmark
from glossaloom.llm.line_dedup import dedupe_lines
from glossaloom.llm.ngram_join import keep_one
from glossaloom.llm.quality import judge
from glossaloom.llm.sentencepiece import Vocabulary, encode
from glossaloom.llm.shared import clear, tables, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZERS = os.environ.get("GLOSSALOOM_TOKENIZERS", "/opt/tokenizers")


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that over 20 and over 1 % of the texts of their host hold."""
    return _as_documents(judge(docs, clean=True).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later runs of repeated lines, of three lines or of 50 words; a document of which no word is left goes."""
    return _as_documents(dedupe_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates: 80 % of the shingles of five words."""
    return keep_one(docs, size=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not make up."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_benchmark(docs, benchmark).where("not contaminated").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    vocabulary = Vocabulary.load(os.path.join(TOKENIZERS, "piece_bpe_32k.model"))
    return encode(docs.select("doc_id", "lang", "source", "text"), vocabulary)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: SQL cannot express the encoding; tests compare the stages with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Of what a stage has written for itself, and of its input, nothing is left when its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            clear(spark, before, but_last=True)
    return docs
