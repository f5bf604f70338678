"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where no piece can reach across (before a run of spaces
and around line feeds), each distinct segment once, and the segments are
concatenated with a separator. A suffix array orders all positions by the
characters that follow; every piece of the vocabulary finds its range of
occurrences by binary search in it. The ranges give the edges (position,
length, piece), which are sorted by position. The edges are then relaxed.

The vocabulary is a BPE model: SentencePiece does not take the path of the
best sum of scores but joins neighbours, best piece first. So relaxation runs
in that order: of all edges that span exactly two current neighbours of a
segment the best one (leftmost on ties) joins them, until none is left. All
segments of a block advance together; long ones (over ``LONG`` characters)
advance alone with a heap. The result equals the library's own encoding.
Characters that no piece holds become byte pieces.

Blocks of distinct text are bounded by ``BLOCK`` characters and the memory of
known segments by ``KNOWN`` entries, so memory follows the longest document.

Null and empty texts have no ids. Texts of any length are handled whole. Rows
are independent, so repeated rows have equal ids and an empty table gives an
empty one. The word separator
U+2581 in a text is read as a space, as in the library, so such a text does not
come back exactly. Extra columns pass through whatever their names; a column
that is named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SPACE = "▁"
BLOCK = 100_000
LONG = 48
KNOWN = 400_000
OUT_IDS = 4_000_000
_CUT = re.compile(" *[^ \n]+|\n| +")
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces of a SentencePiece BPE model, as plain data that can be sent to executors."""

    def __init__(self, pieces: list[str], scores: list[float], special: dict[int, str], bytes_at: int):
        self.pieces, self.special, self.bytes_at = pieces, special, bytes_at
        self.normal = np.array([i for i in range(len(pieces)) if i not in special], np.int64)
        order = np.argsort(-np.array([scores[i] for i in self.normal]), kind="stable")
        #: place of a piece among the scores, best first; equal scores share it
        sorted_scores = np.array([scores[i] for i in self.normal])[order]
        places = np.concatenate([[0], np.cumsum(sorted_scores[1:] != sorted_scores[:-1])])
        self.place = np.full(len(pieces), _NONE >> 32, np.int64)
        self.place[self.normal[order]] = places
        self._ready = False

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        special = {i: "byte" if model.is_byte(i) else "control" for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        pieces = [model.id_to_piece(i) for i in range(n)]
        if any(not re.fullmatch(f"{SPACE}*[^{SPACE}\n]*", pieces[i]) for i in range(n) if i not in special):
            raise ValueError("a piece reaches across a word start or a line feed")
        return cls(pieces, [model.get_score(i) for i in range(n)], special, next(i for i, kind in special.items() if kind == "byte"))

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("pieces", "special", "bytes_at", "normal", "place")} | {"_ready": False}

    def prepare(self) -> None:
        """Tables for matching; made once in each worker."""
        if self._ready:
            return
        texts = [self.pieces[i].replace(SPACE, " ") for i in self.normal]
        self.longest = max(map(len, texts))
        letters = sorted(set("".join(texts)))
        self.code = np.zeros(0x110000, np.uint16)  # 0: held by no piece
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bits = int(len(letters) + 1).bit_length()
        self.each = 64 // self.bits
        self.columns = -(-self.longest // self.each)
        codes = np.zeros((len(texts), self.each * self.columns), np.uint64)
        for row, t in enumerate(texts):
            codes[row, : len(t)] = self.code[[ord(c) for c in t]]
        self.size = np.array([len(t) for t in texts], np.int64)
        top = np.uint64((1 << self.bits) - 1)
        filled = np.where(np.arange(codes.shape[1])[None, :] < self.size[:, None], codes, top)
        self.low, self.high = self._pack(codes), self._pack(filled)
        self.out = [b""] * len(self.pieces)
        for i, p in enumerate(self.pieces):
            self.out[i] = bytes([i - self.bytes_at]) if self.special.get(i) == "byte" else b"" if i in self.special else p.replace(SPACE, " ").encode()
        self._ready = True

    def _pack(self, codes: np.ndarray) -> list[np.ndarray]:
        out = []
        for c in range(self.columns):
            key = np.zeros(len(codes), np.uint64)
            for j in range(self.each):
                key = (key << np.uint64(self.bits)) | codes[:, c * self.each + j]
            out.append(key)
        return out

    def suffix_array(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions in the order of the text that follows (to the longest piece), and their sorted keys."""
        width = self.each * self.columns
        padded = np.concatenate([codes.astype(np.uint64), np.zeros(width, np.uint64)])
        n, keys = len(codes), []
        for c in range(self.columns):
            key = np.zeros(n, np.uint64)
            for j in range(self.each):
                at = c * self.each + j
                key = (key << np.uint64(self.bits)) | padded[at : at + n]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        return order, [k[order] for k in keys]

    def _bound(self, keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of every wanted key in the sorted keys."""
        lo = np.zeros(len(wanted[0]), np.int64)
        hi = np.full(len(wanted[0]), len(keys[0]), np.int64)
        for _ in range(len(keys[0]).bit_length()):
            open_ = lo < hi
            mid = np.where(open_, (lo + hi) >> 1, 0)
            less = np.zeros(len(mid), bool)
            same = np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                have = k[mid]
                less |= same & (have < w)
                same &= have == w
            right = (less | same if after else less) & open_
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece) of every occurrence of every piece, by position."""
        order, keys = self.suffix_array(codes)
        first = self._bound(keys, self.low, False)
        many = np.maximum(self._bound(keys, self.high, True) - first, 0)
        which = np.repeat(np.arange(len(many)), many)
        at = order[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        sort = np.argsort(at, kind="stable")
        at, which = at[sort], which[sort]
        return at, self.size[which], self.normal[which]

    def encode_segments(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment."""
        self.prepare()
        lengths = np.array([len(s) for s in segments], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        codes[begin + lengths] = 0
        table = np.full((len(codes), self.longest + 1), -1, np.int32)
        at, size, piece = self.edges(codes)
        table[at, size] = piece
        starts, sizes = self._relax(table, begin, lengths)
        ids = table[starts, sizes]
        bounds = np.searchsorted(starts, np.concatenate([begin, [len(codes)]]))
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for s in np.unique(np.searchsorted(begin, starts[ids < 0], "right") - 1).tolist():  # bytes of unknown characters
            own = []
            for at_, i in zip(starts[bounds[s] : bounds[s + 1]].tolist(), out[s].tolist(), strict=True):
                own += [i] if i >= 0 else [self.bytes_at + b for b in chr(points[at_]).encode("utf-8", "replace")]
            out[s] = np.array(own, np.int32)
        return out

    def _relax(self, table: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the symbols that are left, by position."""
        done_at, done_size = [], []
        short = lengths <= LONG
        for b, n in zip(begin[~short].tolist(), lengths[~short].tolist(), strict=True):
            a, s = self._relax_long(table, b, n)
            done_at.append(a)
            done_size.append(s)
        b, n = begin[short], lengths[short]
        at = np.repeat(b, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seg = np.repeat(np.arange(len(b)), n)
        size = np.ones(len(at), np.int64)
        place = np.append(self.place, _NONE >> 32)  # of piece -1
        while len(at):
            rank = np.full(len(at), _NONE, np.int64)
            both = size[:-1] + size[1:]
            ok = np.flatnonzero((seg[:-1] == seg[1:]) & (both <= self.longest))
            ids = table[at[ok], both[ok]]
            ok, ids = ok[ids >= 0], ids[ids >= 0]
            rank[ok] = (place[ids] << 32) | ok
            heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            ended = best == _NONE
            stay = np.repeat(~ended, np.diff(np.append(heads, len(at))))
            if ended.any():
                done_at.append(at[~stay])
                done_size.append(size[~stay])
            joined = best[~ended] & 0xFFFFFFFF
            size[joined] += size[joined + 1]
            stay[joined + 1] = False
            at, seg, size = at[stay], seg[stay], size[stay]
        at = np.concatenate(done_at) if done_at else np.zeros(0, np.int64)
        size = np.concatenate(done_size) if done_size else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        return at[order], size[order]

    def _relax_long(self, table: np.ndarray, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        size, left, right = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
        rows, place, heap = table[begin : begin + n], self.place, []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j >= 0 and (both := size[i] + size[j]) <= self.longest and (p := rows[i, both]) >= 0:
                heapq.heappush(heap, (int(place[p]), i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if size[i] != a or j < 0 or size[j] != b:
                continue
            size[i], size[j] = a + b, 0
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        held = np.array(size, np.int64)
        starts = np.flatnonzero(held)
        return starts + begin, held[starts]

    def decode(self, ids) -> str:
        """Text of ids."""
        self.prepare()
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes texts with what is known of earlier segments."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.size = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, segments: list[str]) -> None:
        found, at = [], 0
        while at < len(segments):
            last, n = at, 0
            while last < len(segments) and (last == at or n + len(segments[last]) < BLOCK):
                n += len(segments[last]) + 1
                last += 1
            found += self.v.encode_segments(segments[at:last])
            at = last
        for s in segments:
            self.known[s] = len(self.known)
        sizes = np.array([len(x) for x in found], np.int64)
        held = sum(map(len, self.pool))
        self.pool = [np.concatenate([*self.pool, *found])]
        self.begin = np.concatenate([self.begin, held + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their ends."""
        cut = [_CUT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self._forget()
        new = set()
        for c in cut:
            new.update(c)
        if new := [s for s in new if s not in self.known]:
            self._learn(new)
        index = np.array([x for c in cut for x in map(self.known.__getitem__, c)], np.int64)
        counts = np.array([len(c) for c in cut], np.int64)
        sizes = self.size[index] if len(index) else index
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.arange(total[-1]) + np.repeat(self.begin[index] - total[:-1], sizes) if len(index) else index
        ids = self.pool[0][flat] if len(flat) else np.zeros(0, np.int32)
        return ids.astype(np.int32), total[np.concatenate([[0], np.cumsum(counts)])]


def _parts(column: pa.Array, chars: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a text column of about so many characters."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        held.append(t := value.as_py())
        size += len(t or "")
        if size >= chars:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _encode(vocabulary: Vocabulary, text: str, keep: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for first, texts in _parts(batch.column(text)):
                ids, ends = encoder.encode(texts)
                own = batch.slice(first, len(texts))
                n = pa.array(np.diff(ends), pa.int64())
                if digest:
                    each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    found = [pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in each]), pa.array([vocabulary.decode(x.tolist()) == (t or "") for x, t in zip(each, texts, strict=True)])]
                    names = [*keep, "n_tokens", "ids_sha256", "round_trip"]
                else:
                    found, names = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [*keep, "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), n, *found], names=names)

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids (without the text)."""
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*keep, text).mapInArrow(_encode(vocabulary, text, keep, False), schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids") -> DataFrame:
    """``rows`` with text in place of ids; null ids give an empty text."""
    keep = [c for c in rows.columns if c not in (ids, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([vocabulary.decode(x.as_py() or []) for x in batch.column(ids)], pa.string())], names=[*keep, "text"])

    return rows.select(*keep, ids).mapInArrow(run, T.StructType([rows.schema[c] for c in keep]).add("text", "string"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (of little-endian 32-bit ids) and round_trip (decoding gave the text back)."""
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "round_trip")]
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_tokens", "long").add("ids_sha256", "string").add("round_trip", "boolean")
    return docs.select(*keep, text).mapInArrow(_encode(vocabulary, text, keep, True), schema)
