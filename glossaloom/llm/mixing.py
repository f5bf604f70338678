"""Mixing sources to target weights, in blocks of words that are dealt out to shards.

The words of a source lie in a line, its documents in an order by hash. Blocks
are runs of that line. Each source has an exact number of blocks to give, its
quota; a tree halves the shards again and again and draws, by the multivariate
hypergeometric distribution, which part of each quota either half gets. A shard
then takes the next blocks of a permutation of each source's blocks, so no two
shards share a block of one pass, and puts its pieces in an order of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.let import let
from .ordering import numbered
from .shared import written

BLOCK_WORDS = 1024
#: A source has this many blocks at least, if it has as many words.
BLOCKS = 256
#: Blocks grow beyond so many in all; the draws of a tree must stay below 10**9.
MOST_BLOCKS = 1 << 26
SHARD_WORDS = 1 << 22
#: Documents in each part of a source in which places are found by sorting.
PART = 1 << 12
#: Halvings that a task does at once.
HALVINGS = 4
SEED = 20240613
#: Primes above any number of blocks: steps through the blocks of a source, one for each pass, that meet every block once.
STEPS = (998_244_353, 1_000_000_007)
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    outside = lambda p: F.when(F.element_at(p, 1) == "", 1).otherwise(0) + F.when((F.element_at(p, -1) == "") & (F.size(p) > 1), 1).otherwise(0)
    return let(F.split(F.coalesce(text, F.lit("")), SPACE), lambda p: F.size(p) - outside(p)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """``sources`` (place, words) with ``target``: shares by weight of ``percent`` of all words, at most ``most`` times a source's own.

    What is above that goes to the others by weight, until none is above. Only
    sums reach the driver, one for each time that further sources are full.
    """
    rows = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    total = rows.agg(F.sum(whole("words"))).first()[0]
    num, den, full = 0, 1, F.lit(False)
    while total is not None:
        held = rows.withColumn("full", full).agg(F.sum(F.when(F.col("full"), whole("words"))), F.sum(F.when(~F.col("full"), whole("weight")))).first()
        rest = int(total) * percent - 100 * most * int(held[0] or 0)  # hundredths of words
        if not held[1] or (rest, 100 * int(held[1])) == (num, den):
            break
        num, den = rest, 100 * int(held[1])
        full = whole("words") * F.lit(most).cast("decimal(4,0)") * F.lit(den).cast("decimal(13,0)") <= whole("weight").cast("decimal(4,0)") * F.lit(num).cast("decimal(30,0)")
    share = F.col("weight") * F.lit(float(num)) / F.lit(float(den))
    return rows.withColumn("target", F.when(full, F.col("words") * F.lit(float(most))).otherwise(share).cast("double"))


def split(quotas: np.ndarray, shards: int, first: int, seed: int, depth: int) -> list[tuple[int, int, np.ndarray]]:
    """(first shard, number of shards, quotas) of the parts, after ``depth`` halvings or when one shard is left."""
    if depth == 0 or shards == 1:
        return [(first, shards, quotas)]
    left, total = shards // 2, int(quotas.sum())
    drawn = np.random.default_rng([seed, first, shards]).multivariate_hypergeometric(quotas, total * left // shards)
    return split(drawn, left, first, seed, depth - 1) + split(quotas - drawn, shards - left, first + left, seed, depth - 1)


def _shares(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, shard, quota) by the splitting tree; a task holds one row of each source at most, of one part of the shards."""
    rows = quotas.select("place", F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), "quota")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        found = split(part["quota"].to_numpy(), int(part["shards"].iloc[0]), int(part["first"].iloc[0]), seed, HALVINGS)
        places = part["place"].to_numpy()
        frames = [pd.DataFrame({"place": places[q > 0], "first": at, "shards": n, "quota": q[q > 0]}) for at, n, q in found]
        return pd.concat(frames, ignore_index=True)

    left = shards
    while left > 1:
        rows = rows.groupBy("first", "shards").applyInPandas(run, rows.schema)
        left = -(-left // 2**HALVINGS)
    return rows.select("place", F.col("first").alias("shard"), "quota")


def _hash(id: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id).cast("string"), F.col(text))


@dataclass(frozen=True)
class Mix:
    """``sources`` (key, words, target), ``rows`` (each document and where its source's line has it, null without words) and ``pieces`` (shard, order in the shard, document, words from and to)."""

    sources: DataFrame
    rows: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, part: int = PART, seed: int = SEED) -> Mix:
    """Deal the words of all documents out to shards, each source near its target.

    Sources are ordered by code point, null last, and weighted in turn. A source
    gives ``target / words`` of its blocks, to the nearest block, each at most
    ``most`` times, so no word is taken more often. Pieces are runs of a
    document's words inside one block; a block of a small source has a 256th of
    its words at least one. Null and empty texts have no words and no pieces, an
    empty table gives empty tables. Equal rows lie one behind the other in an
    order of no meaning; rows of one id with other texts are documents of their
    own. The same rows give the same mix, however they are partitioned. Columns
    other than the three have no part in it, whatever their names.
    """
    key = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))
    sized = written(docs.select(F.col(id).alias("id"), key.alias("key"), n_words(F.col(text)).alias("size"), _hash(id, text, seed).alias("h")), "sizes")

    by_source = sized.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    listed = numbered(written(by_source, "sources").withColumn("all", F.lit("")), "all", ["key"], "place", "n_sources")
    listed = written(targets(written(listed, "listed"), weights, percent, most), "targets")
    sums = listed.agg(F.sum("words"), F.count(F.lit(1))).first()
    total, n_sources = int(sums[0] or 0), int(sums[1])
    block = max(block_words, -(-total // MOST_BLOCKS))
    each = max(1, min(BLOCKS, (1 << 28) // max(1, n_sources)))
    sources = listed.where("words > 0").withColumn("block", F.greatest(F.lit(1).cast("long"), F.least(F.expr(f"words div {each}"), F.lit(block).cast("long"))))
    sources = sources.withColumn("n", F.expr("(words + block - 1) div block"))
    sources = sources.withColumn("quota", F.least(F.round(F.col("target") / F.col("words") * F.col("n")).cast("long"), F.col("n") * most))
    sources = written(sources.withColumn("bits", F.ceil(F.log2(F.greatest(F.col("docs") / part, F.lit(1.0)))).cast("int")), "quotas")

    # The line of a source: parts by the first bits of the hash, in each of which a window sums; then the sums of the parts.
    placed = sized.where("size > 0").join(sources.select("key", "place", "block", "bits"), "key")
    placed = placed.withColumn("part", F.when(F.col("bits") == 0, 0).otherwise(F.expr("shiftrightunsigned(h ^ shiftleft(1L, 63), 64 - bits)")).cast("long"))
    inside = Window.partitionBy("place", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))), "placed")
    parts = placed.groupBy("place", "part").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("place", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    rows = placed.join(parts, ["place", "part"]).select("id", "key", "h", "place", "size", "block", (F.col("inside") + F.col("before")).alias("start"))

    # Quotas of shards, the draws that make them up, and the block that each draw takes.
    n_draws = int(sources.agg(F.sum("quota")).first()[0] or 0)
    taken = sources.agg(F.sum(F.col("target"))).first()[0] or 0.0
    shards = max(1, min(n_draws, -(-int(taken) // shard_words)))
    shares = written(_shares(sources.where("quota > 0").select("place", "quota"), shards, seed), "shares")
    to = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    draws = shares.withColumn("from", F.coalesce(F.sum("quota").over(to), F.lit(0))).select("place", "shard", F.explode(F.expr("sequence(from, from + quota - 1)")).alias("j"))
    draws = draws.join(sources.select("place", "n"), "place").withColumn("pass", F.expr("j div n"))
    step = F.get(F.array(*map(F.lit, STEPS)), F.pmod("pass", F.lit(len(STEPS))).cast("int"))
    draws = draws.select("place", "shard", "j", ((step * (F.col("j") % F.col("n")) + F.col("pass") * 7919) % F.col("n")).alias("nth"))

    line = rows.select("id", "key", "h", "place", "size", "start", "block", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")).alias("nth"))
    low = F.greatest(F.col("start"), F.col("nth") * F.col("block")) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), (F.col("nth") + 1) * F.col("block")) - F.col("start")
    line = line.select("id", "key", "h", "place", "size", "start", "nth", low.alias("from_word"), high.alias("to_word"))
    pieces = line.join(draws, ["place", "nth"])
    pieces = pieces.withColumn("order", F.xxhash64(F.lit(seed), "shard", "place", "j", "start"))
    empty = sized.where("size = 0").select("id", "key", "size")
    return Mix(listed.select("key", "words", "target"), rows.unionByName(empty, allowMissingColumns=True), pieces)


def taken(docs: DataFrame, **options) -> DataFrame:
    """For each document: its size in words, its source's size and target, and how many of its words the mix takes. Options as in ``mix``."""
    found = mix(docs, **options)
    drawn = found.pieces.groupBy("place", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = found.rows.join(drawn, ["place", "start"], "left").join(found.sources, "key")
    return rows.select(F.col("id").alias(options.get("id", "doc_id")), "size", F.col("words").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shard_texts(docs: DataFrame, **options) -> DataFrame:
    """The pieces of ``mix`` as (shard, order, id, source, text), words joined by one space; write it sorted by shard and order."""
    id, text, source = (options.get(x, x if x != "id" else "doc_id") for x in ("id", "text", "source"))
    pieces = mix(docs, **options).pieces
    own = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), _hash(id, text, options.get("seed", SEED)).alias("h"))
    own = own.groupBy("h", "id").agg(F.first("source").alias("source"), F.first("text").alias("text"))  # equal rows have equal texts
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    run = F.array_join(F.slice(words, F.col("from_word").cast("int") + 1, (F.col("to_word") - F.col("from_word")).cast("int")), " ")
    joined = pieces.join(own, [pieces["h"] == own["h"], pieces["id"].eqNullSafe(own["id"])])
    return joined.select("shard", "order", own["id"].alias(id), own["source"].alias(source), run.alias(text))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the pieces as Parquet, a folder for each shard with its rows in the shard's own order; a task holds a shard, of about ``shard_words``."""
    rows = shard_texts(docs, **options).repartition("shard").sortWithinPartitions("shard", "order")
    rows.write.partitionBy("shard").parquet(path)
