"""Samples of exact size, the same for the same keys and seed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.clean import clean_sample
from ..functions.hashes import smallest
from ..functions.names import unused


def shuffled(seed: str, *key: str) -> Column:
    """A hash that orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)))


def _order(seed: str, *key: str) -> Column:
    """The first 60 bits of the hash, as a long in the same order."""
    return F.conv(F.substring(shuffled(seed, *key), 1, 15), 16, 10).cast("long")


def _first(df: DataFrame, h: Column, want: Callable[[int], int]) -> Column:
    """True for as many rows of the smallest hashes as ``want`` says of their number. What ``df`` costs is paid once: its hashes stay, a long for each row."""
    (to,) = unused(df.columns, "h")
    hashes = df.select(h.alias(to)).cache()
    cut = smallest(hashes, F.col(to), want(hashes.count()), h)
    hashes.unpersist()
    return cut


def sample_rows(df: DataFrame, percent: float, *, key: Sequence[str], seed: str = "42") -> DataFrame:
    """round(rows * percent / 100) rows: those of the smallest hashes, told by a cut. Rows of equal keys stand or fall together."""
    return df.where(_first(df, _order(seed, *key), lambda n: int(n * percent / 100 + 0.5)))


def smallest_by(df: DataFrame, by: str, sizes: Callable[[DataFrame], DataFrame], *, key: Sequence[str], seed: str = "42") -> DataFrame:
    """Of each value of ``by`` so many rows of the smallest hashes as ``sizes`` says: it adds ``size`` to rows with ``by`` and ``count``.

    Rows are counted by ``by`` and the first 16 bits of the hash, in one pass. A value's counts, at most 65,536, tell in
    which of these parts its last row lies; in a second pass rows are ranked within their part, so no task gathers a
    value, however many rows it has.
    """
    part, edge, need, rank, own = unused(df.columns, "part", "edge", "need", "rank", "own")
    hashed = df.withColumn(part, F.conv(F.substring(shuffled(seed, *key), 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy(by, part).agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), F.col("n").alias("n")))).alias("parts"))
    start = F.struct(F.lit(-1).alias("edge"), F.lit(0).cast("long").alias("need"), F.lit(0).cast("long").alias("before"))

    def step(at: Column, x: Column) -> Column:
        further = F.struct(x["part"].alias("edge"), (F.col("size") - at["before"]).cast("long").alias("need"), (at["before"] + x["n"]).alias("before"))
        return F.when(at["before"] < F.col("size"), further).otherwise(at)

    cut = F.aggregate("parts", start, step)
    edges = sizes(counts).select(F.col(by).alias(own), cut.alias("cut")).select(own, F.col("cut.edge").alias(edge), F.col("cut.need").alias(need))
    some = hashed.join(edges, hashed[by].eqNullSafe(edges[own])).where(F.col(part) <= F.col(edge))
    ranked = some.withColumn(rank, F.row_number().over(W.partitionBy(by, part).orderBy(shuffled(seed, *key), *key)))
    return ranked.where((F.col(part) < F.col(edge)) | (F.col(rank) <= F.col(need))).select(*df.columns)


def sample_rows_by(df: DataFrame, by: str, percent: float, *, key: Sequence[str], seed: str = "42") -> DataFrame:
    """round(rows * percent / 100) rows of each source, of the smallest hashes."""
    return smallest_by(df, by, lambda counts: counts.withColumn("size", F.floor(F.col("count") * percent / 100 + 0.5)), key=key, seed=seed)


def sample_files(paths: DataFrame, percent: float, *, path: str = "path", seed: str = "42") -> DataFrame:
    """floor(files * percent / 100) files. Paths that are equal stand or fall together."""
    return paths.where(_first(paths, _order(seed, path), lambda n: int(n * percent / 100)))


def by_ids(df: DataFrame, ids: DataFrame, *, id: str = "id") -> DataFrame:
    """Rows whose id was sampled before; an id may be listed several times."""
    return df.join(ids.select(id), id, "left_semi")


def sample_documents(df: DataFrame, *, key: Sequence[str], text: str = "text", percent: float = 1, most: int = 250_000, seed: str = "42") -> DataFrame:
    """A sample of a document store to look at: ``percent`` of the rows, ``most`` at most, with cleaned text and "" for nulls."""
    chosen = df.where(_first(df, _order(seed, *key), lambda n: min(most, int(n * percent / 100)))).withColumn(text, clean_sample(F.col(text)))
    return chosen.fillna("", [f.name for f in df.schema if f.dataType.simpleString() == "string"])


def split(df: DataFrame, train_percent: int = 80, *, key: Sequence[str], seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key."""
    share = F.conv(F.substring(shuffled(seed, *key), 1, 8), 16, 10).cast("long") * 100
    first = share < F.lit(train_percent * 2**32)
    return df.where(first), df.where(~first)
