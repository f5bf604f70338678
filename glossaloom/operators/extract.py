"""Keyword-in-context extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import clean
from ..functions.let import once
from ..functions.tokens import any_in, contexts, sentence_tokens, word_tokens


def keyword_gate(df: DataFrame, keywords: Sequence[str], *, text: str = "text", ignore_case: bool = False) -> DataFrame:
    """Rows whose raw text holds a keyword. The test is case-sensitive unless asked otherwise, and runs before cleaning."""
    value = F.lower(text) if ignore_case else F.col(text)
    return df.where(any_in(value, [k.lower() for k in keywords] if ignore_case else keywords))


def chunks_of(text: Column, keywords: Sequence[str], n: int = 6, mode: str = "word", keep_num: bool = False, html: bool = True) -> Column:
    """Cleaned context windows around each keyword hit; overlapping and repeated ones stay."""
    if mode not in ("word", "sentence"):
        raise ValueError("mode is word or sentence")
    cleaned = F.lower(clean(text, keep_num, html))
    return contexts(word_tokens(cleaned) if mode == "word" else sentence_tokens(cleaned), keywords, n)


def extract(df: DataFrame, keywords: Sequence[str], n: int = 6, *, text: str = "text", mode: str = "word", keep_num: bool = False, ignore_case: bool = False, html: bool = True, fields: Sequence[str] | None = None) -> DataFrame:
    """``fields`` (all others by default) with ``chunks``; rows without a chunk or with an empty field go."""
    fields = [c for c in df.columns if c != text] if fields is None else list(fields)
    rows = keyword_gate(df, keywords, text=text, ignore_case=ignore_case)
    strings = {c for c, kind in df.dtypes if kind == "string"}
    for c in fields:
        rows = rows.where(F.col(c).isNotNull() & (F.col(c) != "") if c in strings else F.col(c).isNotNull())
    rows = rows.select(*fields, once(chunks_of(F.col(text), keywords, n, mode, keep_num, html)).alias("chunks"))
    return rows.where(F.size("chunks") > 0)


def exploded(extracts: DataFrame) -> DataFrame:
    """One row for each chunk, with its place ``pos`` in the row."""
    return extracts.select(*(c for c in extracts.columns if c != "chunks"), F.posexplode("chunks").alias("pos", "chunk"))


def to_text(extracts: DataFrame) -> DataFrame:
    """Chunks joined by ``|``, as in CSV files."""
    return extracts.withColumn("text", F.array_join("chunks", "|")).drop("chunks")


def from_text(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("chunks", F.split(text, r"\|")).drop(text)


def merged_text(a: str, b: str, empty: str = "empty") -> Column:
    """Two chunk texts joined by ``|``, leaving out empty ones."""
    given = lambda c: F.nullif(F.col(c), F.lit(empty))
    return F.concat_ws("|", given(a), given(b))
