"""N-gram Jaccard join: signature trees over blocks that share a rare shingle.

A document is the set of its distinct ``size``-word shingles. Two documents
link when ``100 * |A & B| >= percent * |A | B|``. The steps:

1. Shingles are counted over all documents in a table of ``2**BITS`` buckets, or
   in a second pass of up to ``2**MOST_BITS`` if a bucket would stand for more
   than ``LOAD`` of them. That gives one order of all shingles, rare buckets
   first. Two sets that link share one of their first
   ``n - ceil(percent * n / 100) + 1`` shingles in that order.
2. Equal sets are one from here on, known by two hashes of the set; they are
   linked whatever their number. Each set is put in the block of each of its
   first shingles. Blocks of one set go; blocks of the same sets are one; and a
   block goes when all its sets have their largest block in common, as that one
   holds all its pairs.
3. In each block the sets, by size, are the leaves of a signature tree. A node
   holds the range of sizes and the OR (and AND) of token bitmaps. The tree is
   traversed against itself, and a pair of nodes is pruned when the sizes or
   the bitmaps bound the overlap below what a link needs. A first traversal,
   over bitmaps alone, leaves out sets that no other can link with; the sets
   are then fetched for the rest only. The second also prunes pairs of nodes
   that are known to be connected, and verifies exactly what is left.
4. A block of more than ``BIG`` sets or ``BIG_SHINGLES`` shingles is cut into
   chunks, each compared inside and with about ``HUBS`` sets of the block.
   Whatever is not in the block's largest component after that is compared with
   all chunks, so no link between components is lost while a block of near
   copies takes one pass. So no task holds more than about that much.
5. Links inside blocks are joined into components.

A shingle of which the bucket holds more than ``LIGHT`` shingles, or more than
one in ``HEAVY`` of all, may be in very many sets. Such shingles are counted by
partial sums and joined to their sets; the others, of which there are ``LIGHT``
at most, are brought together by shingle. Keyed tables are written before they are joined and joined by sorting,
so nothing that grows is broadcast, and a hot shingle or block is dealt over
several tasks by the adaptive skew join.

A text without words has an empty set and links with nothing; one of fewer
words than ``size`` has its whole sequence as one shingle; nulls count as
empty. Texts of any length are whole sets. Ids should be distinct; rows that
repeat an id share the component. A row without an id links with nothing and
has no component; ``keep_one`` keeps it. An empty table gives an empty one.
Other columns are ignored here and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import components
from .shared import sieved, unused, written
from .words import blocks, lower_ascii, mix, white_space_words, window_hashes, window_starts

SIZE = 4
PERCENT = 85
BITS, MOST_BITS = 18, 24
LOAD = 4096
LIGHT = 100_000
BIG = 2000
BIG_SHINGLES = 4_000_000
HEAVY = 4096
HUBS = 32
LEAF = 8
SEEN = 200_000


def _sets(block, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document of a block."""
    hashes = block.hashes()
    shingles, ok = window_hashes(hashes, size), window_starts(block.bounds, size)
    shingles = shingles[np.flatnonzero(ok)] if len(shingles) else shingles
    ends = np.concatenate([[0], np.cumsum(np.maximum(block.counts() - size + 1, 0))])
    for i in range(block.last - block.first):
        if ends[i] < ends[i + 1]:
            yield np.unique(shingles[ends[i] : ends[i + 1]])
        else:
            own = hashes[block.bounds[i] : block.bounds[i + 1]]
            yield window_hashes(own, len(own)) if len(own) else own


def _count_buckets(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), white_space_words(), lower_ascii()):
                shingles = window_hashes(block.hashes(), size)
                total += np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def _sign(size: int, percent: int, counts: np.ndarray):
    most = min(LIGHT, int(counts.sum()) // HEAVY)
    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(1), white_space_words(), lower_ascii()):
                sizes, keys, others, firsts, ends, light, bitmaps = [], [], [], [np.zeros(0, np.uint64)], [0], [], []
                for own, known in zip(_sets(block, size), batch.column(0).slice(block.first, block.last - block.first).is_valid().to_pylist(), strict=True):
                    n, (key, other) = len(own), _set_key(own)
                    if n and known and (whole := key << 64 ^ other) not in seen:  # what this task has told of an equal set holds for this one
                        if len(seen) >= SEEN:
                            seen = set()
                        seen.add(whole)
                        held = counts[(own >> shift).astype(np.int64)]
                        order = np.lexsort((own, held))[: n - (percent * n + 99) // 100 + 1]
                        firsts.append(own[order])
                        ends.append(ends[-1] + len(order))
                        light.append(int((held[order] <= most).sum()))
                        bitmaps.append(bitmap(own, width_for(n)).tobytes())
                    else:
                        ends.append(ends[-1])
                        light.append(0)
                        bitmaps.append(None)
                    sizes.append(n)
                    keys.append(key)
                    others.append(other)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64))), pa.array(light, pa.int32()), pa.array(bitmaps, pa.binary())],
                    names=["id", "n", "key", "other", "first", "light", "bits"],
                )

    return run


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles by the first bits of their hash; the table has so many that what a bucket stands for is bounded, up to ``MOST_BITS``."""
    bits = BITS
    while True:
        counts = np.zeros(1 << bits, np.int64)
        counted = docs.select("text").mapInArrow(_count_buckets(size, bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        found = counted.toArrow()  # 2**MOST_BITS rows at most
        counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
        wanted = min(MOST_BITS, int(counts.sum() * 16 // LOAD).bit_length())
        if wanted <= bits or counts.sum() <= LOAD << bits:
            return counts
        bits = wanted


def _set_key(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    if not len(own):
        return 0, 0
    n = np.uint64(len(own))
    sums = np.array([mix(own).sum(dtype=np.uint64) + n, mix(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) ^ n], np.uint64)
    return tuple(mix(sums).view(np.int64).tolist())


def width_for(n: int) -> int:
    """Bits of the bitmap of n shingles: a power of two, 2n at least."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(own: np.ndarray, width: int) -> np.ndarray:
    """The shingles of a set as bits, by the low bits of their hash."""
    flags = np.zeros(width, np.uint8)
    flags[(own & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be in fewer words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), 0)


class SignatureTree:
    """Sets by size, with the bitmaps and sizes of every node; a node is a range of leaves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, percent: int):
        self.sizes, self.bits, self.percent = sizes, bits, percent
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _node(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """OR and AND of the bitmaps of leaves [a, b)."""
        if (a, b) not in self.nodes:
            if b - a <= LEAF:
                self.nodes[a, b] = np.bitwise_or.reduce(self.bits[a:b]), np.bitwise_and.reduce(self.bits[a:b])
            else:
                (o1, n1), (o2, n2) = self._node(a, (a + b) // 2), self._node((a + b) // 2, b)
                self.nodes[a, b] = o1 | o2, n1 & n2
        return self.nodes[a, b]

    def _needed(self, n, m):
        """Overlap that sets of these sizes need."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def _apart(self, a: int, b: int, c: int, d: int) -> bool:
        """No set of [a, b) can link with one of [c, d)."""
        (n1, n2), (m1, m2) = (self.sizes[a], self.sizes[b - 1]), (self.sizes[c], self.sizes[d - 1])
        if n2 * 100 < self.percent * m1 or m2 * 100 < self.percent * n1:
            return True
        if (a, b) == (c, d) or b - a <= LEAF and d - c <= LEAF:
            return False
        (or1, and1), (or2, and2) = self._node(a, b), self._node(c, d)
        most = min(n2 - int(np.bitwise_count(and1 & ~or2).sum()), m2 - int(np.bitwise_count(and2 & ~or1).sum()))
        return most < self._needed(int(n1), int(m1))

    def _pairs(self, a: int, b: int, c: int, d: int) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that the bitmaps leave possible."""
        x, y = self.bits[a:b, None, :], self.bits[None, c:d, :]
        n, m = self.sizes[a:b, None], self.sizes[None, c:d]
        most = np.minimum(n - np.bitwise_count(x & ~y).sum(2), m - np.bitwise_count(y & ~x).sum(2))
        for i, j in zip(*np.nonzero(most >= self._needed(n, m)), strict=True):
            if i < j or (a, b) != (c, d):
                yield int(i) + a, int(j) + c

    def traverse(self, settled: Callable[[int, int, int, int], bool]) -> Iterator[tuple[int, int]]:
        """Possible pairs, by dual traversal of the tree against itself. Pairs of nodes of which all is settled are pruned."""
        stack = [(0, len(self.sizes), 0, len(self.sizes))]
        while stack:
            a, b, c, d = stack.pop()
            if settled(a, b, c, d) or self._apart(a, b, c, d):
                continue
            if b - a <= LEAF and d - c <= LEAF:
                yield from self._pairs(a, b, c, d)
                continue
            m, k = (a + b) // 2, (c + d) // 2
            if (a, b) == (c, d):
                stack += [(a, m, m, b), (m, b, m, b), (a, m, a, m)]  # inside first, so that what lies across is often settled
            elif b - a >= d - c:
                stack += [(m, b, c, d), (a, m, c, d)]
            else:
                stack += [(a, b, k, d), (a, b, c, k)]


def connected(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels of sets, in order of size, that verified links connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    width = width_for(int(sizes.max())) // 64
    label = np.arange(len(sets))

    def settled(a: int, b: int, c: int, d: int) -> bool:
        return bool((label[a:b] == label[a]).all() and (label[c:d] == label[a]).all())

    for i, j in SignatureTree(sizes, np.stack([bitmap(s, width * 64) for s in sets]), percent).traverse(settled):
        if label[i] != label[j]:
            x, y = sets[i], sets[j]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                label[label == label[j]] = label[i]
    return label


def promising(sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets, in order of size, may link with another by sizes and bitmaps."""
    told = np.zeros(len(sizes), bool)
    gaps = np.flatnonzero(sizes[:-1] * 100 < percent * sizes[1:]) + 1  # no link reaches across
    for a, b in zip([0, *gaps.tolist()], [*gaps.tolist(), len(sizes)], strict=True):
        if b - a < 2:
            continue
        maps = [np.frombuffer(x, np.uint64) for x in bits[a:b]]
        words = min(map(len, maps))
        own = told[a:b]

        def settled(p: int, q: int, r: int, s: int, own=own) -> bool:
            return bool(own[p:q].all() and own[r:s].all())

        for i, j in SignatureTree(sizes[a:b], np.stack([folded(x, words) for x in maps]), percent).traverse(settled):
            own[i] = own[j] = True
    return told


def _by_group(answer: Callable[[pa.Table], pa.RecordBatch]):
    """Apply to rows whose first column, by which they come together, is equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if group is not None and groups[x] != group:
                    yield answer(pa.Table.from_batches(held).combine_chunks())
                    held = []
                group = groups[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield answer(pa.Table.from_batches(held).combine_chunks())

    return run


def _own_sets(size: int):
    """Rows (id, text) to (id, own): the sorted shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), white_space_words(), lower_ascii()):
                own = [x.tobytes() for x in _sets(block, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(own)), pa.array(own, pa.binary())], names=["id", "own"])

    return run


def _connect(percent: int):
    """Links of rows (task, id, own)."""

    def answer(rows: pa.Table) -> pa.RecordBatch:
        ids = rows["id"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["own"]]
        order = np.lexsort((ids, [len(s) for s in sets]))
        ids = ids[order]
        label = connected([sets[i] for i in order], percent)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        root = least[label]
        told = root != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(root[told])], names=["a", "b"])

    return _by_group(answer)


def _promise(percent: int):
    """Rows (blk, id, n, bits) that may link inside their block."""

    def answer(rows: pa.Table) -> pa.RecordBatch:
        n = rows["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        bits = rows["bits"].to_pylist()
        told = order[promising(n[order], [bits[i] for i in order], percent)]
        return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[told]) for c in ("blk", "id", "n")], names=["blk", "id", "n"])

    return _by_group(answer)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of tasks (task, id) over the sets of their texts."""
    some, _ = sieved(texts, "id", members, "id")
    rows = members.join(some.mapInArrow(_own_sets(size), "id long, own binary").hint("merge"), "id").select("task", "id", "own")
    return rows.repartition(_partitions(rows), "task").sortWithinPartitions("task").mapInArrow(_connect(percent), "a long, b long")


def _needed(members: DataFrame, name: str) -> DataFrame:
    """Members (blk, name, n) with ``cnt`` and ``all`` (their number and shingles), without blocks whose sets all have their largest block in common."""
    sizes = written(members.groupBy("blk").agg(F.count("*").alias("cnt"), F.sum("n").alias("all")).where("cnt > 1"), "sizes")
    counted = members.join(sizes.hint("merge"), "blk")
    # a set is in as many blocks as it has first shingles at most
    counted = written(counted.withColumn("top", F.max(F.struct("cnt", "blk")).over(W.partitionBy(name))["blk"]), "tops")
    told = written(counted.groupBy("blk").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo <> hi or lo = blk").select("blk"), "told")
    return counted.drop("top").join(told.hint("merge"), "blk", "left_semi")


def _shared(signed: DataFrame, percent: int) -> DataFrame:
    """(blk, key, n): sets that share a first shingle with another of a size that may link; blocks of the same sets are one."""
    mark = lambda key: (F.count("*"), F.sum(F.xxhash64(key) % F.lit(1 << 40)), F.bit_xor(F.xxhash64(key)))
    blk = F.xxhash64("c", "x", "y").alias("blk")
    signed = signed.where(F.size("first") > 0)
    light = signed.select("key", "n", F.explode(F.slice("first", F.lit(1), F.col("light"))).alias("token"))
    light = light.repartition(_partitions(signed), "token").dropDuplicates(["token", "key"])
    by = W.partitionBy("token")
    sized = by.orderBy("n")
    near = light.withColumn("before", F.lag("n").over(sized)).withColumn("after", F.lead("n").over(sized))
    near = near.where((100 * F.col("before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after")))
    met = near.select("key", "n", *(x.over(by).alias(a) for x, a in zip(mark("key"), "cxy", strict=True))).where("c > 1").select("key", "n", blk)
    heavy = signed.where(F.size("first") > F.col("light")).select("key", "n", F.explode(F.expr("slice(first, light + 1, size(first))")).alias("token"))
    heavy = written(heavy.dropDuplicates(["token", "key"]), "heavy")
    marks = written(heavy.groupBy("token").agg(*(x.alias(a) for x, a in zip(mark("key"), "cxy", strict=True))).where("c > 1").select("token", blk), "marks")
    return met.unionByName(heavy.join(marks.hint("merge"), "token").select("key", "n", "blk")).dropDuplicates(["blk", "key"])


def _blocks_of(signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(blk, cnt, all, id): the sets of each block that is needed, by the smallest id that holds the set."""
    met = written(_needed(written(_shared(signed, percent), "shared"), "key"), "met")
    some, _ = sieved(signed.where(F.col("bits").isNotNull()), "key", met, "key")
    bitmaps = some.groupBy("key", "other").agg(F.first("bits").alias("bits"))
    met = met.join(sets.hint("merge"), "key").withColumnRenamed("least", "id")
    big = (F.col("cnt") > BIG) | (F.col("all") > BIG_SHINGLES)
    small = met.where(~big).join(bitmaps.hint("merge"), ["key", "other"]).select("blk", "id", "n", "bits")
    small = small.repartition(_partitions(signed), "blk").sortWithinPartitions("blk").mapInArrow(_promise(percent), "blk long, id long, n long")
    return _needed(written(small.unionByName(met.where(big).select("blk", "id", "n")), "promising"), "id").select("blk", "cnt", "all", "id")


def join_classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): the size of each document's set and the smallest id that it reaches by links."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    signed = written(docs.mapInArrow(_sign(size, percent, _counts(docs, size)), "id long, n long, key long, other long, first array<bigint>, light int, bits binary"), "signatures")
    sets = written(signed.where("n > 0 and id is not null").groupBy("key", "other").agg(F.min("id").alias("least")), "sets")
    needed = written(_blocks_of(signed, sets, percent), "blocks")
    is_big = (F.col("cnt") > BIG) | (F.col("all") > BIG_SHINGLES)
    small, big = needed.where(~is_big), needed.where(is_big)
    tasks = small.select(F.col("blk").alias("task"), "id")
    some_big = bool(big.head(1))
    chunks = F.greatest(F.ceil(F.col("cnt") / BIG), F.ceil(F.col("all") / BIG_SHINGLES))
    if some_big:
        chunk = F.pmod(F.xxhash64("id"), chunks)
        # about HUBS sets of each block, by hash
        hubs = big.where(F.pmod(F.xxhash64("id", F.lit(1)), F.col("cnt")) < HUBS)
        spread = hubs.select("blk", "id", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("c"))
        tasks = tasks.unionByName(big.select("blk", "id", chunk.alias("c")).unionByName(spread).distinct().select(F.xxhash64("blk", "c").alias("task"), "id"))
    links = written(_links(written(tasks, "tasks"), docs, size, percent), "links")
    roots = components(links)
    if some_big:
        # sets outside their block's largest component meet all chunks of the block
        placed = big.join(roots.hint("merge"), F.col("id") == F.col("node"), "left").select("blk", "cnt", "all", "id", F.coalesce("root", "id").alias("root"))
        placed = written(placed, "placed")
        parts = placed.groupBy("blk", "root").agg(F.count("*").alias("m"))
        top = written(parts.groupBy("blk").agg(F.max(F.struct("m", "root")).alias("top")).select("blk", F.col("top.root").alias("top")), "top")
        rest = written(placed.join(top.hint("merge"), "blk").where("root <> top"), "rest")
        groups = written(rest.groupBy("blk").agg(F.ceil(F.count("*") / BIG).alias("groups")), "groups")
        rest = rest.join(groups.hint("merge"), "blk").select("blk", "cnt", "all", "id", "groups", F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")).alias("g"))
        everyone = placed.join(groups.hint("merge"), "blk").select("blk", "id", F.pmod(F.xxhash64("id"), chunks).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))
        other = rest.select("blk", "id", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("c"), "g")
        again = written(everyone.unionByName(other).distinct().select(F.xxhash64("blk", "c", "g").alias("task"), "id"), "again")
        roots = components(links.unionByName(_links(again, docs, size, percent)))
    # sets find their component first, so that documents are joined once, to a table by itself
    found = written(sets.join(roots.hint("merge"), F.col("least") == F.col("node"), "left").select("key", "other", F.coalesce("root", "least").alias("component")), "components")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    placed = signed.select("id", "n", F.when(linked, F.col("key")).alias("key"), F.when(linked, F.col("other")).alias("other")).join(found.hint("merge"), ["key", "other"], "left")
    return placed.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with only the document of the smallest id of each component; rows without an id stay."""
    classes = join_classes(docs, id=id, text=text, size=size, percent=percent)
    of = unused(docs.columns, "of")[0]
    gone = written(classes.where(F.col(id) != F.col("component_id")).select(F.col(id).alias(of)), "gone")
    some, others = sieved(docs, F.col(id).cast("long"), gone, of)
    return some.join(gone.hint("merge"), some[id] == gone[of], "left_anti").unionByName(others)
