"""How far the terms of each source diverge from those of its language and of the other sources.

Shares are whole billionths, so all arithmetic is exact. The strongest terms of
a group (language and source) are searched for by bounds: terms of nearly the
same count are a bucket, whose highest share and lowest share of the language
bound the value of all its terms. Buckets are evaluated from the highest bound
on, and none whose bound is strictly below the value of the last rank. Pairs
of sources are summed over posting lists, that is over the sources that have a
term; what terms give that only one or neither has follows from the groups'
counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written
from .words import Block, blocks, lower_ascii

UNIT = 1_000_000_000
MIN_DOCS = 3
TOP = 200
#: Counts below this have a bucket each; above, each doubling has 8.
EXACT = 32
#: Sources of a block; tasks sum pairs of blocks.
BLOCK = 128
#: Pairs that a task holds at once, and pairs of blocks that it sums before it hands them on.
PAIRS = 1 << 19
HELD = 64
#: Rows of sums that a task holds.
SUMS = 1 << 19


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / total)``"""
    return 1 + _div((count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def letters() -> np.ndarray:
    """Bytes of terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``."""
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _terms_of(block: Block, lang: pa.Array, source: pa.Array, table: np.ndarray, fold: np.ndarray) -> pa.Table:
    """(lang, source, term, n, docs) of the documents of a block."""
    offsets = np.zeros(len(block.start) + 1, np.int32)
    np.cumsum(block.end - block.start, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(block.start), pa.py_buffer(offsets), pa.py_buffer(fold[block.data[table[block.data]]]))
    coded = words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    in_row, count = np.unique(block.rows() * n + coded.indices.to_numpy(), return_counts=True)
    lang, source = (x.slice(block.first, block.last - block.first).dictionary_encode() for x in (lang, source))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    keys, at, docs = np.unique(group[in_row // n] * n + in_row % n, return_inverse=True, return_counts=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, count)
    group = keys // n
    return pa.table({"lang": lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))), "source": source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))), "term": coded.dictionary.take(pa.array(keys % n)), "n": sums, "docs": docs})


def _summed(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns({"n_sum": "n", "docs_sum": "docs"})


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's documents, which go on whenever they have ``SUMS`` rows."""
    table, fold = letters(), lower_ascii()
    held: list[pa.Table] = []
    least = SUMS // 4
    for batch in batches:
        text, lang, source = (batch.column(c) for c in ("text", "lang", "source"))
        for block in blocks(text, table):
            held.append(_terms_of(block, lang, source, table, fold))
            if sum(map(len, held)) > least:
                held = [_summed(held)]
                if len(held[0]) > SUMS:
                    yield from held[0].to_batches()
                    held = []
                least = SUMS // 4 + sum(map(len, held))
    if held:
        yield from _summed(held).to_batches()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents."""
    terms = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    return terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _bucket(n: Column) -> Column:
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(8 * F.log2(n / EXACT))).cast("int")


def top_terms(scored: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank) of the ``top`` terms above their language's share in each group."""
    group = Window.partitionBy("lang", "source")
    above = scored.where("p > q").withColumn("bucket", _bucket(F.col("n")))
    buckets = above.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("m"))
    buckets = buckets.withColumn("bound", divergence(F.col("p"), F.col("q")))
    best_first = group.orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.withColumn("before", F.coalesce(F.sum("m").over(best_first), F.lit(0))).drop("p", "q"), "buckets")

    def best(rows: DataFrame) -> DataFrame:
        """Only the first ``top`` of each task go to the task of their group."""
        return rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)

    def of(chosen: DataFrame) -> DataFrame:
        rows = above.join(chosen.select("lang", "source", "bucket"), ["lang", "source", "bucket"])
        return rows.select("lang", "source", "term", divergence(F.col("p"), F.col("q")).alias("value"))

    first = written(best(of(buckets.where(F.col("before") < top))), "best")  # the first buckets that hold ``top`` terms
    last = first.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    # The value of the last rank can only rise from here, so what is below it now is never looked at.
    rest = buckets.where(F.col("before") >= top).join(last, ["lang", "source"]).where(F.col("bound") >= F.col("kth"))
    return best(first.drop("rank").unionByName(of(rest)))


def pair_sums(postings: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each pair of sources of two blocks, what the terms that both have add to the rest, summed over this task's terms."""
    held: dict[tuple, np.ndarray] = {}
    f = lambda p, q: (p - q) * (p - q) // q

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), sums in held.items():
            a, b = np.nonzero(sums)
            no = lambda x, i=i, j=j: np.where(x < size, i * size + x, j * size + x - size)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(no(a), pa.int64()), pa.array(no(b), pa.int64()), pa.array(sums[a, b], pa.int64())], ["lang", "a", "b", "both"])
        held.clear()

    for batch in postings:
        lists = batch.column("entries")
        entry = lists.flatten()
        no, p, p0 = (entry.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        lengths = np.diff(np.asarray(lists.offsets))
        ends = np.cumsum(lengths)
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True))
        row = 0
        while row < len(keys):
            key, until, n = keys[row], row, 0
            while until < len(keys) and keys[until] == key and (until == row or n + int(lengths[until]) ** 2 <= PAIRS):
                n += int(lengths[until]) ** 2
                until += 1
            low, high = int(ends[row] - lengths[row]), int(ends[until - 1])
            k = np.repeat(lengths[row:until], lengths[row:until]).astype(np.int64)  # of each entry: entries of its list
            head = np.repeat(ends[row:until] - lengths[row:until] - low, lengths[row:until])
            x = np.repeat(np.arange(high - low), k)
            y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(head, k)
            _, i, j = key
            local = no[low:high] - i * size if i == j else np.where(no[low:high] // size == i, no[low:high] - i * size, no[low:high] - j * size + size)
            fits = local[x] != local[y] if i == j else (local[x] < size) != (local[y] < size)
            x, y = x[fits], y[fits]
            pa_, pb, pa0, pb0 = p[low:high][x], p[low:high][y], p0[low:high][x], p0[low:high][y]
            sums = held.setdefault(key, np.zeros((2 * size, 2 * size), np.int64))
            np.add.at(sums, (local[x], local[y]), f(pa_, pb) - f(pa_, pb0) - f(pa0, pb) + f(pa0, pb0))
            row = until
            if len(held) > HELD:
                yield from out()
    yield from out()


def pairs(scored: DataFrame, groups: DataFrame, size: int = BLOCK) -> DataFrame:
    """(lang, source, other, value) for each two sources of a language."""
    n_blocks = groups.groupBy("lang").agg(F.expr(f"max(no) div {size} + 1").alias("n_blocks"))
    listed = groups.join(n_blocks, "lang").withColumn("block", F.expr(f"no div {size}"))
    listed = written(listed, "groups")
    entries = scored.join(listed.select("lang", "source", "no", "p0", "block", "n_blocks"), ["lang", "source"])
    entries = entries.select("lang", "term", F.struct("no", "p", "p0").alias("entry"), "block", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("with"))
    postings = entries.groupBy("lang", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "term").agg(F.collect_list("entry").alias("entries"))
    both = postings.where(F.size("entries") > 1).drop("term").sortWithinPartitions("lang", "i", "j").mapInArrow(lambda batches: pair_sums(batches, size), "lang string, a long, b long, both long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))

    counts = scored.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("counts"))
    of = listed.join(counts, ["lang", "source"], "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<p:bigint,m:bigint>>")))
    one = of.select("lang", "v", F.col("source").alias("source"), F.col("no").alias("a"), F.col("p0").alias("pa"), F.col("own").alias("na"), F.col("counts").alias("ca"), F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    other = of.select("lang", "block", F.col("source").alias("item"), F.col("no").alias("b"), F.col("p0").alias("pb"), F.col("own").alias("nb"), F.col("counts").alias("cb"))
    total = lambda counts, value: F.aggregate(counts, F.lit(0).cast("long"), lambda t, c: t + c["m"] * value(c["p"]))
    rest = total("ca", lambda p: divergence(p, F.col("pb"))) + total("cb", lambda p: divergence(F.col("pa"), p)) + (F.col("v") - F.col("na") - F.col("nb")) * divergence(F.col("pa"), F.col("pb"))
    met = one.join(other, ["lang", "block"]).where("a != b").select("lang", "source", "item", "a", "b", F.when(F.col("v") == 0, 0).otherwise(rest).alias("rest"))
    return met.join(both, ["lang", "a", "b"], "left").select("lang", "source", "item", (F.col("rest") + F.coalesce("both", F.lit(0))).cast("long").alias("value"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each group from its language's other sources, and its strongest terms.

    Null texts, languages and sources are read as empty. A term is a run of
    ASCII letters, lower-cased, and of characters beyond ASCII; a language keeps
    those of at least ``min_docs`` rows. Rows that repeat count each. Groups
    without a kept term have pairs, with the shares of terms that never occur;
    in a language without kept terms all pairs have the value 0. Ties are in the
    order of the items' UTF-8 bytes. An empty table gives none. Texts may be of
    any length; other columns have no part in it, whatever their names.
    """
    given = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    docs = docs.select(given(lang, "lang"), given(source, "source"), given(text, "text"))
    counts = written(counted(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    posts = written(counts.drop("docs").join(kept, ["lang", "term"]), "posts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    own = posts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("n_own"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "n_own", "v", "lang_n"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n_own") + F.col("v"))).otherwise(1)), "sources")
    scored = posts.join(groups.select("lang", "source", "n_own", "lang_n", "v"), ["lang", "source"])
    scored = written(scored.select("lang", "source", "term", "n", share(F.col("n"), F.col("n_own") + F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_n") + F.col("v")).alias("q")), "scored")

    of_pairs = pairs(scored, groups, block).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    of_terms = top_terms(scored, top).withColumnRenamed("term", "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return of_pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(of_terms.withColumn("part", F.lit("term")).select(*columns))
