"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``size`` words (an item of fewer words is one
window). A window is a set of ``shingle``-word shingles that a document has to
contain whole, so by the prefix filter a window and a document that matches it
share the first ``|W| - |W| + 1 = 1`` shingle of the window in any fixed order.
The order is rarity. The steps:

1. Distinct windows, each with the items that hold it. Items are told by the
   set of those of a window, so that a document that holds many windows of one
   item says so once.
2. The windows' shingles, which a sieve of bits tells, are counted over all
   documents, in a table that has some buckets for each of them (``2**MOST_BITS``
   at most); each window gets its rarest shingle as its prefix.
3. Documents emit the places whose shingle may be a prefix, by a sieve of bits
   of bounded size, with the words around them. They are joined to the windows
   by shingle; the length and positional bounds (the window has to fit around
   the shingle) and then the words themselves decide.
4. Hits meet by text, so copies of a text are one, and documents are joined to
   the hits of their text. Texts without a hit are not moved.

There is one way for any number of items. Keyed tables are written before they
are joined, so that a hot shingle, or a text that is copied often, is dealt
over several tasks by the adaptive skew join; neither windows, items nor counts
of them are collected or broadcast.

Null texts and texts without words have no words and are never hit. Texts of
any length are handled whole. Rows are judged by their text alone, so rows that
repeat an id, or have none, are judged like others. Items that repeat an id
count once; one without an id makes hits and is not listed. Empty tables of
documents or items give no rows or no hits. Extra columns pass through
whatever their names; a column that is named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import sieved, unused, written
from .words import alphanumeric_words, blocks, lower_ascii, window_hashes

SIZE = 13
SHINGLE = 3
#: Bits of the table of counts, which has COUNT_SHARE buckets for each shingle of a window as far as these allow.
BITS, MOST_BITS, COUNT_SHARE = 16, 22, 8
#: The sieve has this many bits for each window, and this power of two at most.
SIEVE_SHARE, SIEVE_BITS = 32, 24
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = ("n_words", "n_hit", "items", "hit_words", "contaminated")


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _windows(size: int):
    """Rows (item, text) to (item, words): the windows of each item, by the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), alphanumeric_words(), lower_ascii()):
                hashes, counts = block.hashes().view(np.int64), block.counts()
                n = np.minimum(counts, size)
                many = np.where(n > 0, counts - n + 1, 0)
                row = np.repeat(np.arange(len(counts)), many)
                begin = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + block.bounds[row]
                length = n[row]
                at = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.first + row)), _lists(hashes[at], np.cumsum(length))], names=["item", "words"])

    return run


def _tokens(shingle: int):
    """Windows (words) to (token): all their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ends = words.offsets.to_numpy()
            flat, lengths, begin = words.values.to_numpy().view(np.uint64), np.diff(ends), ends[:-1]
            found = [np.zeros(0, np.uint64)]
            for n in np.unique(lengths).tolist():
                k, own = min(shingle, n), flat[begin[lengths == n][:, None] + np.arange(n)]
                found += [window_hashes(own[:, j : j + k].ravel(), k)[::k] for j in range(n - k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["token"])

    return run


def _sieved_places(token: np.ndarray, bits: int, sieves: list[np.ndarray]) -> np.ndarray:
    """Places of the tokens that both tables know."""
    shift = np.uint64(64 - bits)
    at = np.flatnonzero(sieves[0][(token >> shift).astype(np.int64)])
    return at[sieves[1][((token[at] << np.uint64(bits)) >> shift).astype(np.int64)]]


def _count_shingles(ks: list[int], count_bits: int, bits: int, tables: list[np.ndarray]):
    """Places of the windows' shingles by the first bits of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [np.unpackbits(t.view(np.uint8), bitorder="little").view(bool) for t in tables]
        total = np.zeros(1 << count_bits, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), alphanumeric_words(), lower_ascii()):
                hashes = block.hashes()
                for k in ks:
                    token = window_hashes(hashes, k)
                    token = token[_sieved_places(token, bits, sieves)]
                    if len(token):
                        np.add.at(total, (token >> np.uint64(64 - count_bits)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def _prefixes(shingle: int, counts: np.ndarray):
    """Adds to windows their rarest shingle (token) and its place (offset); ties by value."""

    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ends = words.offsets.to_numpy()
            flat, lengths, begin = words.values.to_numpy().view(np.uint64), np.diff(ends), ends[:-1]
            token, offset = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int32)
            for n in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == n)
                k = min(shingle, n)
                own = flat[begin[of][:, None] + np.arange(n)]
                each = np.stack([window_hashes(own[:, j : j + k].ravel(), k)[::k] for j in range(n - k + 1)], 1)
                first = np.lexsort((each, counts[(each >> shift).astype(np.int64)]), axis=1)[:, 0]
                token[of], offset[of] = each[np.arange(len(of)), first], first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(token.view(np.int64)), pa.array(offset)], names=[*batch.schema.names, "token", "offset"])

    return run


def _sieve(tokens: DataFrame, n: int) -> tuple[int, list[np.ndarray]]:
    """Two tables of 2**bits bits, at most 2**SIEVE_BITS, in which the tokens are set; by different bits of them."""
    bits = min(SIEVE_BITS, max(16, (SIEVE_SHARE * n).bit_length()))
    tables = []
    for k in (0, bits):
        place = F.shiftrightunsigned(F.shiftleft("token", k), 64 - bits)
        words = tokens.select(place.alias("p")).select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("one"))
        found = words.groupBy("word").agg(F.bit_or("one").alias("ones")).toArrow()  # 2**(SIEVE_BITS - 6) rows at most
        table = np.zeros((1 << bits) // 64, np.int64)
        table[found["word"].to_numpy()] = found["ones"].to_numpy()
        tables.append(table)
    return bits, tables


def _candidates(ks: list[int], size: int, bits: int, tables: list[np.ndarray]):
    """Rows (ka, kb, text) to (ka, kb, token, pos, at, around): places that may hold a prefix, and the words around them from place pos - at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [np.unpackbits(t.view(np.uint8), bitorder="little").view(bool) for t in tables]
        for batch in batches:
            for block in blocks(batch.column(2), alphanumeric_words(), lower_ascii()):
                hashes, row_of = block.hashes(), None
                for k in ks:
                    token = window_hashes(hashes, k)
                    at = _sieved_places(token, bits, sieves)
                    if not len(at):
                        continue
                    row_of = block.rows() if row_of is None else row_of
                    row = row_of[at]
                    inside = at + k <= block.bounds[1:][row]
                    at, row = at[inside], row[inside]
                    lo, hi = np.maximum(block.bounds[row], at - size + 1), np.minimum(block.bounds[row + 1], at + size)
                    length = hi - lo
                    place = np.repeat(lo, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                    rows = pa.array(block.first + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(token[at].view(np.int64)), pa.array((at - block.bounds[row]).astype(np.int32)), pa.array((at - lo).astype(np.int32)), _lists(hashes[place].view(np.int64), np.cumsum(length))],
                        names=["ka", "kb", "token", "pos", "at", "around"],
                    )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ka, kb, spans) to (ka, kb, n_hit, hit_words): words inside any span, and the starts and ends of their runs."""
    for batch in batches:
        spans = batch.column("spans")
        ends = spans.offsets.to_numpy()
        begins, lengths = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
        n_hit, runs = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            order = np.argsort(begins[a:b], kind="stable")
            begin = begins[a:b][order]
            end = np.maximum.accumulate(begin + lengths[a:b][order])
            new = np.append(True, begin[1:] > end[:-1])
            first, last = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            n_hit.append(int((last - first).sum()))
            runs.append(np.stack([first, last], 1).ravel().astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["ka", "kb", "n_hit", "hit_words"])


def _two(c: Column | str) -> tuple[Column, Column]:
    """Two independent hashes."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def _hits(texts: DataFrame, windows: DataFrame, size: int, shingle: int) -> DataFrame | None:
    """(ka, kb, n_hit, hit_words, items) of the texts (ka, kb, text) that hold windows (words, items)."""
    sa, sb = _two("items")
    windows = written(windows.select("words", "items", sa.alias("sa"), sb.alias("sb")), "windows")
    told = windows.agg(F.count("*").alias("n"), F.collect_set(F.least(F.size("words"), F.lit(shingle))).alias("ks")).first()  # at most ``shingle`` numbers
    if not told.n:
        return None
    ks = sorted(told.ks)
    tokens = written(windows.select("words").mapInArrow(_tokens(shingle), "token long").distinct(), "tokens")
    n_tokens = tokens.count()
    count_bits = min(MOST_BITS, max(BITS, (COUNT_SHARE * n_tokens).bit_length()))
    counts = np.zeros(1 << count_bits, np.int64)
    counted = texts.select("text").mapInArrow(_count_shingles(ks, count_bits, *_sieve(tokens, n_tokens)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**MOST_BITS rows at most
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    prefixed = written(windows.select("words", "sa", "sb").mapInArrow(_prefixes(shingle, counts), "words array<long>, sa long, sb long, token long, offset int"), "prefixes")
    bits, tables = _sieve(prefixed, told.n)
    places = texts.mapInArrow(_candidates(ks, size, bits, tables), "ka long, kb long, token long, pos int, at int, around array<long>")
    met = places.join(prefixed.hint("merge"), "token").withColumn("from", F.col("at") - F.col("offset"))
    fits = (F.col("from") >= 0) & (F.col("from") + F.size("words") <= F.size("around"))
    same = F.when(fits, F.slice("around", F.greatest(F.col("from"), F.lit(0)) + 1, F.size("words")) == F.col("words")).otherwise(False)
    found = met.where(same).select("ka", "kb", F.struct((F.col("pos") - F.col("offset")).alias("begin"), F.size("words").alias("n")).alias("span"), F.struct("sa", "sb").alias("set"))
    by_text = written(found.groupBy("ka", "kb").agg(F.collect_set("span").alias("spans"), F.collect_set("set").alias("sets")), "spans")
    sets = written(windows.groupBy("sa", "sb").agg(F.first("items").alias("items")), "sets")
    each = by_text.select("ka", "kb", F.explode("sets").alias("s")).select("ka", "kb", "s.sa", "s.sb")
    items = each.join(sets.hint("merge"), ["sa", "sb"]).groupBy("ka", "kb").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = by_text.select("ka", "kb", "spans").mapInArrow(_merge, "ka long, kb long, n_hit long, hit_words array<long>")
    return written(merged.join(items.hint("merge"), ["ka", "kb"]), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, shingle: int = SHINGLE, min_percent: int = 5) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside occurrences of item windows), items (ids as sorted
    strings), hit_words (starts and ends of the hit runs, in words) and contaminated (some word is
    hit and hits make up ``min_percent`` per cent of the words)."""
    keep = [c for c in docs.columns if c not in RESULT]
    a, b = _two(text)
    texts = docs.where(F.col(text).isNotNull()).select(a.alias("ka"), b.alias("kb"), F.col(text).alias("text"))
    of_items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).mapInArrow(_windows(size), "item string, words array<long>")
    hits = _hits(texts, of_items.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")), size, shingle)
    n_hit, items, hit_words = F.lit(0).cast("long"), F.array().cast("array<string>"), F.array().cast("array<long>")
    rows = docs.select(*keep)
    if hits is not None:
        ka, kb, n, i, w = unused(keep, "ka", "kb", "n", "i", "w")
        hits = hits.toDF(ka, kb, n, w, i)
        some, others = sieved(rows, F.when(F.col(text).isNotNull(), a), hits, ka)
        some = some.join(hits.hint("merge"), (a == hits[ka]) & (b == hits[kb]), "left").drop(ka, kb)
        rows = some.unionByName(others.select("*", *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in (n, w, i))))
        n_hit, items, hit_words = F.coalesce(n, n_hit), F.coalesce(i, items), F.coalesce(w, hit_words)
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    out = rows.select(*keep, n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), hit_words.alias("hit_words"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))
