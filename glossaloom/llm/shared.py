"""Tables written to the shared folder, to cut lineage and to be read again.

They stay there, as results may be computed from them later. ``clear`` removes
those of this process once its results are written elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossaloom.functions.names import unused
from glossaloom.sources.shared import shared_dir

__all__ = ["SIEVE_BITS", "clear", "shared_dir", "sieved", "tables", "unused", "written"]

_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; survives lost executors.

    A keyed table that was written is a plain scan, so a join to it can be dealt
    anew where a key is hot (adaptive skew join), which no join to an aggregate can.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glossaloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0, *, but_last: bool = False) -> int:
    """Remove the tables that this process has written, or those since it had written so many; results that were not yet computed need them. Gives their number."""
    n, kept = 0, [_paths.pop()] if but_last and len(_paths) > since else []
    while len(_paths) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _paths.extend(kept)
    return n


def tables() -> int:
    """How many tables this process has written and not removed."""
    return len(_paths)


SIEVE_BITS = 1 << 22


def sieved(rows: DataFrame, key: Column | str, wanted: DataFrame, wanted_key: Column | str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be among those of ``wanted``, and the others, without moving a row.

    Keys are hashed to ``SIEVE_BITS`` bits, which are broadcast as at most
    ``SIEVE_BITS / 64`` rows of 64 bits: that bound does not grow with the data.
    With many more keys than bits, more rows than needed are in the first part;
    both parts together are always all rows. Null keys are in the second part.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    key, wanted_key = col(key), col(wanted_key)
    bit, at, word, ones, may, own = unused(rows.columns, "bit", "at", "word", "ones", "may", "own")
    place = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(SIEVE_BITS))
    mask = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` % 64 as int))")
    words = wanted.where(wanted_key.isNotNull()).select(place(wanted_key).alias(bit))
    words = words.select(F.expr(f"`{bit}` div 64").alias(word), mask(bit).alias(own)).groupBy(word).agg(F.bit_or(own).alias(ones))
    placed = rows.withColumn(bit, F.when(key.isNotNull(), place(key))).withColumn(at, F.expr(f"`{bit}` div 64"))
    placed = placed.join(F.broadcast(words), placed[at] == words[word], "left")
    placed = placed.withColumn(may, F.coalesce(F.col(ones).bitwiseAND(mask(bit)) != 0, F.lit(False))).drop(bit, at, word, ones)
    return placed.where(F.col(may)).drop(may), placed.where(~F.col(may)).drop(may)
