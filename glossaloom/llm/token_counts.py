"""Token counts by dynamic programming over a trie of pre-tokens.

Each partition inserts the distinct pre-tokens (words with their leading word
separator) of its batches in a trie, taken in depth-first order: words are
sorted, and the path of the last word is kept, so the forward state of a
shared prefix is computed once. The state of a node is the best unigram score
of the prefix and its number of tokens; a word's terminal state is stored as
its count. A document's count is the sum over its words. Nothing is shuffled.

Unigram scores come from the vocabulary's order by Zipf's law: the piece at
place r costs ``round(10**6 * log(r + 2))``; whole numbers make ties exact, and
ties go to fewer tokens. A character that no piece holds costs
``10**6 * log(size) + 10**7`` for each of its UTF-8 bytes, each one token.

Stored counts are bounded by ``KNOWN`` words a partition and start anew
beyond that. Null and empty texts have no pre-tokens. Texts of any length are
handled whole. Rows are independent, so repeated rows have equal counts and an
empty table gives an empty one. Extra columns pass through whatever their
names; a column that is named like a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

KNOWN = 500_000


class Unigram:
    """Costs of the pieces of a vocabulary, best first."""

    def __init__(self, pieces: list[str]):
        self.cost = {p: round(1e6 * math.log(r + 2)) for r, p in enumerate(dict.fromkeys(pieces))}
        self.longest = max(map(len, self.cost), default=1)
        self.unknown = round(1e6 * math.log(len(self.cost) + 2)) + 10**7

    @classmethod
    def load(cls, model_file: str) -> Unigram:
        """Pieces of a SentencePiece model, by score."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        return cls([model.id_to_piece(i) for i in sorted(ids, key=lambda i: -model.get_score(i))])


class TrieCounter:
    """Terminal token counts of words."""

    def __init__(self, unigram: Unigram):
        self.unigram = unigram
        self.known: dict[bytes, int] = {}

    def insert(self, words: list[bytes]) -> None:
        """Insert new words, in depth-first order of the trie."""
        cost, longest, unknown = self.unigram.cost, self.unigram.longest, self.unigram.unknown
        texts = sorted(("▁" + w.decode("utf-8", "replace"), w) for w in words)
        path, state = "", [(0, 0)]  # state of each node on the path: cost, tokens
        for text, word in texts:
            n = len(text)
            shared, most = 0, min(len(path), n)
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, n + 1):
                letter = text[end - 1]
                best = None
                for begin in range(max(0, end - longest), end):
                    c = cost.get(text[begin:end])
                    if c is not None:
                        before = state[begin]
                        new = (before[0] + c, before[1] + 1)
                        if best is None or new < best:
                            best = new
                if letter not in cost:
                    size = len(letter.encode("utf-8", "replace"))
                    new = (state[end - 1][0] + size * unknown, state[end - 1][1] + size)
                    if best is None or new < best:
                        best = new
                state.append(best)
            path = text
            self.known[word] = state[n][1]

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        # bytes split at the same ASCII white space as [^\x20\x09-\x0D]+
        split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        self.insert([w for w in new if w not in self.known])
        get = self.known.__getitem__
        return [len(words) for words in split], [sum(map(get, words)) for words in split]


def _run(unigram: Unigram, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(unigram)
        for batch in batches:
            column = batch.column(text)
            bounds = [0]
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else []
            held = 0
            for i, n in enumerate(sizes):
                held += int(n)
                if held > 4_000_000:
                    bounds.append(i + 1)
                    held = 0
            bounds = [*bounds, len(column)] if bounds[-1] != len(column) else bounds
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(a, b - a)
                words, tokens = counter.count(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, unigram: Unigram, *, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with n_pretokens and n_tokens."""
    keep = [c for c in docs.columns if c not in (text, "n_pretokens", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_pretokens", "long").add("n_tokens", "long")
    return docs.select(*keep, text).mapInArrow(_run(unigram, text, keep), schema)
