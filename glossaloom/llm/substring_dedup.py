"""Substring dedup: compressed FM-indexes over shards of shared passages.

A window is ``size`` consecutive words of a document. A word goes if a window
that covers it also starts in a document with a smaller id; windows are judged
on the input. The steps:

1. Each window has a minimiser, the smallest hash of its ``GRAM``-word grams.
   Equal windows have equal minimisers, so a minimiser that one document alone
   holds settles its windows. Minimisers are counted over all documents by
   partial sums and joined back to those that may be shared.
2. Windows with a shared minimiser are sent, as runs of words, to the shard of
   the minimiser. There is one shard for each ``PER_SHARD`` holders counted in
   step 1, so shards keep their size however large the corpus is.
   A minimiser that ``HOT`` documents or more hold would overload its shard.
   Its windows are told by two hashes of their words; their smallest id comes
   from partial sums and is joined back to them, so a passage that a third of
   the corpus holds is dealt over all tasks.
3. A shard indexes each distinct run once, with the smallest id that holds it:
   suffix order to ``size`` words, Burrows-Wheeler transform, and a wavelet
   matrix of packed bits. The runs are then streamed through backward search,
   all windows at once, word by word; a window leaves as soon as its interval
   holds one place only. Intervals that reach ``size`` words are reported with
   the smallest id inside them.
4. Reported windows of larger ids are put together as runs of words by document.

Only passages that pass step 1 are moved, and texts that lose something once
more for the result. Keyed tables are written before they are joined, so that a
hot minimiser is dealt over several tasks by the adaptive skew join.

Null and empty texts have no words. Texts of any length are handled whole, in
memory that follows the longest one. Ids should be distinct; rows that repeat an
id do not count against each other, and each loses what any of them loses. A
row without an id loses nothing and counts against none. An empty table gives an
empty one. Extra columns pass through whatever their names; a column that is
named like a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import sieved, unused, written
from .words import blocks, mix, white_space_words, window_hashes, window_starts

SIZE = 13
GRAM = 4
HOT = 10_000
PER_SHARD = 1 << 13


class WaveletMatrix:
    """Ranks of symbols over packed bits, a level for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels = len(symbols), max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        lo, hi = np.zeros(len(ends), np.int64), ends
        for k in range(self.levels):
            one = (symbols >> (self.levels - 1 - k)) & 1 == 1
            lo1, hi1 = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[k] + hi1, hi - hi1)
        return hi - lo

    def _ones(self, k: int, ends: np.ndarray) -> np.ndarray:
        word = ends >> 6
        mask = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)


class FmIndex:
    """Index of a text of symbols from 1; 0 separates runs."""

    def __init__(self, text: np.ndarray, top: int, depth: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            _, rank = np.unique(rank * (n + top + 2) + after, return_inverse=True)
            width *= 2
        #: Places in the order of the ``width`` symbols that follow; enough for searches to ``depth``.
        self.order = np.argsort(rank, kind="stable").astype(np.int32)
        before = text[self.order - 1]
        before[self.order == 0] = 0
        self.wavelet = WaveletMatrix(before, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])

    def intervals(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows at starts that occur twice or more: which of them, and their intervals of ``order``."""
        which = np.arange(len(starts))
        c = text[starts + size - 1]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(size - 2, -1, -1):
            more = hi - lo > 1  # a match of fewer words elsewhere ends here
            which, lo, hi = which[more], lo[more], hi[more]
            c = text[starts[which] + k]
            lo, hi = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
        more = hi - lo > 1
        return which[more], lo[more], hi[more]


def _minimisers(hashes: np.ndarray, size: int) -> np.ndarray:
    """The minimiser of the window at each word; of all runs of ``size`` words, also across rows."""
    grams = window_hashes(hashes, GRAM)
    span = size - GRAM + 1
    out, width = grams, 1
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if rest := span - width:
        out = np.minimum(out[:-rest], out[rest:])
    return out


def _block_windows(block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, first words of windows, their minimisers."""
    hashes = block.hashes()
    if len(hashes) < size:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(window_starts(block.bounds, size))
    return hashes, at, _minimisers(hashes, size)[at]


def _held(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), white_space_words()):
                _, at, key = _block_windows(block, size)
                row = block.rows()[at]
                new = np.ones(len(at), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[block.first + row[new]])], names=["key", "id"])

    return run


def _runs(size: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2)
            key_ends = keys.offsets.to_numpy() - (keys.offsets[0].as_py() if len(keys) else 0)
            flat = keys.flatten()
            key_values, key_hot = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), white_space_words()):
                hashes, at, key = _block_windows(block, size)
                whole = mix(window_hashes(hashes, size)) if len(at) else key
                other = window_hashes(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), size) if len(at) else key
                row = block.rows()[at]
                bounds = np.searchsorted(row, np.arange(block.last - block.first + 1))
                wanted, hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
                for i in range(block.last - block.first):
                    a, b = bounds[i], bounds[i + 1]
                    if a < b:
                        own = slice(key_ends[block.first + i], key_ends[block.first + i + 1])
                        k = np.argsort(key_values[own])
                        v, h = key_values[own][k], key_hot[own][k]
                        p = np.minimum(np.searchsorted(v, key[a:b]), len(v) - 1)
                        wanted[a:b] = v[p] == key[a:b]
                        hot[a:b] = h[p] & wanted[a:b]
                at, key, row, hot = at[wanted], key[wanted], row[wanted], hot[wanted]
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = hot[1:] | (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(at)) - 1
                by = np.where(hot[heads], whole[at[heads]], mix(key[heads]))
                # equal hot windows of a document are one row with all their places
                order = np.lexsort((at[heads], by, row[heads], hot[heads]))
                heads, tails, by = heads[order], tails[order], by[order]
                first = np.ones(len(heads), bool)
                first[1:] = ~hot[heads[1:]] | (by[1:] != by[:-1]) | (row[heads[1:]] != row[heads[:-1]])
                places = (at[heads] - block.bounds[row[heads]]).astype(np.int32)
                places_end = np.append(np.flatnonzero(first), len(heads)).astype(np.int32)
                heads, tails, by = heads[first], tails[first], by[first]
                cold = ~hot[heads]
                begin, end = block.start[at[heads]].tolist(), block.end[at[tails] + size - 1].tolist()
                data = block.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((by % np.uint64(shards)).astype(np.int32)), pa.array(ids[block.first + row[heads]]), pa.ListArray.from_arrays(pa.array(places_end), pa.array(places)),
                        pa.array([data[a:b] if c else None for a, b, c in zip(begin, end, cold.tolist(), strict=True)], pa.binary()),
                        pa.array(by.view(np.int64), mask=cold), pa.array(other[at[heads]].view(np.int64), mask=cold),
                    ],
                    names=["shard", "id", "places", "run", "wa", "wb"],
                )

    return run


def _search(ids: np.ndarray, places: pa.Array, runs: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, from, to): runs of words of a shard's rows that stand in a smaller id."""
    hashes, lengths = [], []
    for block in blocks(runs.cast(pa.string()) if pa.types.is_binary(runs.type) else runs, white_space_words()):
        hashes.append(block.hashes())
        lengths.append(block.counts())
    hashes, lengths = np.concatenate(hashes), np.concatenate(lengths)
    ends = np.cumsum(lengths)
    # distinct runs, each with its smallest id
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(hashes)) - np.repeat(ends - lengths, lengths)).astype(np.uint64)))])
    _, example, kind = np.unique(mix(total[ends] - total[ends - lengths]) + lengths.astype(np.uint64), return_index=True, return_inverse=True)
    least = np.full(len(example), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    n_words = lengths[example]
    words = np.repeat(ends[example] - lengths[example], n_words) + np.arange(n_words.sum()) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    distinct, symbols = np.unique(hashes[words], return_inverse=True)
    begin = np.cumsum(n_words + 1) - n_words - 1
    text = np.zeros(int(n_words.sum()) + len(example), np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(example)), n_words)] = symbols + 1
    index = FmIndex(text, len(distinct), size)
    # every window, by kind of run
    n_windows = n_words - size + 1
    window_end = np.cumsum(n_windows)
    starts = np.arange(n_windows.sum()) + np.repeat(begin - (window_end - n_windows), n_windows)
    found = np.repeat(least, n_windows)
    which, lo, hi = index.intervals(text, starts, size)
    if len(which):
        holder = np.repeat(least, n_words + 1)
        by, at = np.unique(lo, return_index=True)
        edges = np.stack([by, hi[at]], 1).ravel()
        smallest = np.minimum.reduceat(np.append(holder[index.order], np.iinfo(np.int64).max), edges)[::2]
        found[which] = np.minimum(found[which], smallest[np.searchsorted(by, lo)])
    # the windows of every row that a smaller id holds
    per_row = n_windows[kind]
    first = np.cumsum(per_row) - per_row
    offset = np.arange(per_row.sum()) - np.repeat(first, per_row)
    gone = found[np.repeat((window_end - n_windows)[kind], per_row) + offset] < np.repeat(ids, per_row)
    row = np.repeat(np.arange(len(ids)), per_row)[gone]
    offset = offset[gone]
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(row)) - 1
    # at every place of the row
    row, offset, last = row[heads], offset[heads], offset[tails]
    ends = places.offsets.to_numpy().astype(np.int64)
    many = np.diff(ends)[row]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[row], many)
    at = places.values.to_numpy()[at].astype(np.int64)
    return np.repeat(ids[row], many), at + np.repeat(offset, many), at + np.repeat(last, many) + size


def _search_shards(size: int):
    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, a, b = _search(rows["id"].to_numpy(), rows["places"].combine_chunks(), rows["run"].combine_chunks(), size)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if shard is not None and shards[x] != shard:
                    yield answer(held)
                    held = []
                shard = shards[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield answer(held)

    return run


def repeated_spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(id, spans): runs of words (a, b), b exclusive, that also stand in documents of smaller id."""
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    held = written(rows.mapInArrow(_held(size), "key long, id long"), "minimisers")
    keys = held.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    keys = written(keys.select("key", "n"), "keys")
    shards = max(1, (keys.agg(F.sum("n")).first()[0] or 0) // PER_SHARD)
    some, _ = sieved(held, "key", keys, "key")
    shared = some.join(keys.hint("merge"), "key")
    wanted = shared.groupBy("id").agg(F.collect_set(F.struct("key", (F.col("n") >= HOT).alias("hot"))).alias("keys"))
    runs = rows.join(wanted.hint("merge"), "id").select("id", "text", "keys").mapInArrow(_runs(size, shards), "shard int, id long, places array<int>, run binary, wa long, wb long")
    runs = written(runs, "runs")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.where("run is not null").select("shard", "id", "places", "run").repartition(partitions, "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(_search_shards(size), "id long, a int, b int")
    hot = runs.where("run is null").select("wa", "wb", "id", "places")
    least = written(hot.groupBy("wa", "wb").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("wa", "wb", "lo"), "least")
    late = hot.join(least.hint("merge"), ["wa", "wb"]).where("id > lo").select("id", F.explode("places").alias("a"))
    found = found.unionByName(late.withColumn("b", F.col("a") + size))
    return found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _cut(keep: list[str], text: str, lost: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(lost).to_pylist()
            n_words, n_removed, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            column = batch.column(text)
            for block in blocks(column, white_space_words()):
                data = block.data.tobytes()
                n_words[block.first : block.last] = block.counts()
                starts, ends = block.start.tolist(), block.end.tolist()
                for i in range(block.first, block.last):
                    a, b = int(block.bounds[i - block.first]), int(block.bounds[i - block.first + 1])
                    stay = np.ones(b - a, bool)
                    for s in spans[i] or ():
                        stay[s["a"] : s["b"]] = False
                    n_removed[i] = b - a - stay.sum()
                    words = b" ".join([data[starts[a + k] : ends[a + k]] for k in np.flatnonzero(stay).tolist()]) if n_removed[i] else b" ".join(data[starts[a] : ends[b - 1]].split()) if b > a else b""
                    kept.append(hashlib.sha256(words).hexdigest() if digest else words.decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string())], names=[*keep, "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def dedupe_substrings(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SIZE, digest: bool = False) -> DataFrame:
    """``docs`` (without the text) with n_words, n_removed and kept: the words that stay, joined by one space;
    with ``digest``, kept_sha256 in its place."""
    result = "kept_sha256" if digest else "kept"
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_removed", result)]
    of, lost = unused(docs.columns, "of", "lost")
    spans = written(repeated_spans(docs, id=id, text=text, size=size), "spans").toDF(of, lost)
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_words", "long").add("n_removed", "long").add(result, "string")
    # texts that keep all their words are not moved
    some, others = sieved(docs, F.col(id).cast("long"), spans, of)
    some = some.join(spans.hint("merge"), some[id] == spans[of], "left").select(*(some[c] for c in keep), text, lost)
    others = others.select(*keep, text, F.lit(None).cast(spans.schema[lost].dataType).alias(lost))
    cut = _cut(keep, text, lost, digest)
    return some.mapInArrow(cut, schema).unionByName(others.mapInArrow(cut, schema))
