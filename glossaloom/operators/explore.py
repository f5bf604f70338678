"""Counting chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.tokens import any_in, trim_words
from .sample import sample_rows

#: A summary of m chunks is off by at most this part of all rows, divided by m.
ERROR = 3.5


def chunk_counts(extracts: DataFrame, keys: Sequence[str], n: int | None = None, *, mode: str = "word", chunks: str = "chunks") -> DataFrame:
    """(chunk, count) of chunks with one of the keys, trimmed to n words on either side."""
    rows = extracts.select(F.explode(chunks).alias("chunk")).where(any_in(F.col("chunk"), keys))
    if n is not None:
        rows = rows.select((trim_words(F.col("chunk"), n) if mode == "word" else F.btrim("chunk")).alias("chunk"))
    return rows.groupBy("chunk").agg(F.count("*").alias("count"))


def top_chunks(counts: DataFrame, x: int = 100) -> DataFrame:
    """The x most frequent chunks; ties by text."""
    if not 0 <= x <= 1000:
        raise ValueError("x is from 0 to 1000")
    return counts.orderBy(F.desc("count"), "chunk").limit(x)


def random_chunks(counts: DataFrame, x: int = 100, seed: str = "42") -> DataFrame:
    """x chunks, or all if there are fewer, by a hash of their text."""
    if not 0 <= x <= 1000:
        raise ValueError("x is from 0 to 1000")
    return counts.orderBy(F.md5(F.concat(F.lit(seed), "chunk")), "chunk").limit(x)


def frequent_chunks(chunks: DataFrame, x: int = 100, *, chunk: str = "chunk", tracked: int = 10_000) -> DataFrame:
    """As ``top_chunks`` of the counts, without moving every distinct chunk where a few are frequent.

    Tasks keep summaries of at most ``tracked`` chunks, which are merged; only the chunks that these name are counted
    exactly. If the x-th count is above all that a chunk outside the summary can have, the result is proven and whole;
    if not, all chunks are counted. The chunks are read twice, and in the second case three times.
    """
    if not 0 <= x <= 1000:
        raise ValueError("x is from 0 to 1000")
    rows = chunks.select(F.col(chunk).alias("chunk"))
    asked = min(10 * max(x, 1), tracked // 2)
    told = rows.where("chunk is not null").agg(F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", "chunk", F.lit(asked), F.lit(tracked)).alias("top")).first()
    named = told["top"] or []
    # A summary's estimates are never below the count, and what it does not name is below its last estimate or its error.
    unseen = max(ERROR * told["n"] / tracked, named[-1]["count"] if len(named) == asked else 0)
    if len(named) >= x > 0:
        held = chunks.sparkSession.createDataFrame([(r["item"],) for r in named], "chunk string")
        exact = top_chunks(rows.join(F.broadcast(held), "chunk").groupBy("chunk").agg(F.count("*").alias("count")), x)
        found = exact.collect()  # x rows
        if len(found) == x and found[-1]["count"] > unseen:
            return chunks.sparkSession.createDataFrame(found, exact.schema)
    return top_chunks(rows.groupBy("chunk").agg(F.count("*").alias("count")), x)


def preview(df: DataFrame, mode: str = "FIRST", x: int = 100, *, order: Sequence[str] = (), key: Sequence[str] = (), seed: str = "42") -> DataFrame:
    """The first or x random rows; these by a hash of ``key``, or of all columns, so not of how the rows are stored."""
    if not 0 <= x <= 1000:
        raise ValueError("x is from 0 to 1000")
    if mode == "RANDOM":
        told = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in key) if key else (F.to_json(F.struct(*df.columns)),)))
        return df.orderBy(told, *key).limit(x)
    return (df.orderBy(*order) if order else df).limit(x)


def highlight_table(extracts: DataFrame, keys: Sequence[str], *, key: Sequence[str], percent: float = 10, chunks: str = "chunks", seed: str = "42") -> DataFrame:
    """A share of the extracts to look through: a column for each chunk, and ``marked``, the numbers of those with a key.

    Rows are chosen by a hash of ``key``. There are as many columns as the longest of the chosen rows has chunks. The
    chosen rows are cached, as the columns and then the result are told from them; the extracts are computed twice.
    """
    rows = sample_rows(extracts, percent, key=key, seed=seed).cache()
    width = rows.agg(F.max(F.size(chunks))).first()[0] or 0
    marked = F.filter(F.transform(chunks, lambda c, i: F.when(any_in(c, keys), i + 1)), lambda i: i.isNotNull())
    return rows.select(*(c for c in rows.columns if c != chunks), marked.alias("marked"), *(F.get(chunks, F.lit(i)).alias(f"chunk_{i + 1}") for i in range(width)))


def split_chunks(extracts: DataFrame, keys: Sequence[str] = (), *, chunks: str = "chunks") -> DataFrame:
    """One row for each chunk with its place and whether it holds a key."""
    rows = extracts.select(*(c for c in extracts.columns if c != chunks), F.posexplode(chunks).alias("pos", "chunk"))
    return rows.withColumn("highlight", any_in(F.col("chunk"), keys))
