"""Vectorised word splitting and hashing over Arrow text columns.

A batch is handled as one UTF-8 byte array. Every separator used here is
ASCII, so splitting bytes splits code points the same way. Blocks are cut at
document ends once they reach ``BLOCK`` bytes, so memory follows the longest
document rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SLOT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def white_space_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = False
    return table


def alphanumeric_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in text whose A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the hash's step and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            steps = np.full(size, _STEP, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _BACK
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up, self.down


class Block:
    """Consecutive documents of a batch: rows [first, last) and their words."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int, table: np.ndarray, fold: np.ndarray | None, powers: Powers):
        self.powers = powers
        self.data, self.first, self.last = data, first, first + len(ends) - 1
        is_word = table[data] if len(data) else np.zeros(0, bool)
        begin = is_word.copy()
        begin[1:] &= ~is_word[:-1]
        finish = is_word.copy()
        finish[:-1] &= ~is_word[1:]
        heads = ends[:-1][ends[:-1] < ends[1:]]
        tails = ends[1:][ends[:-1] < ends[1:]] - 1
        begin[heads] = is_word[heads]
        finish[tails] = is_word[tails]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        #: Words of row i are [bounds[i], bounds[i + 1]).
        self.bounds = np.searchsorted(self.start, ends)
        self.fold = fold

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row (within the block) of each word."""
        return np.repeat(np.arange(self.last - self.first), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = self.powers.to(len(self.data) + 1)
        table = _BYTE if self.fold is None else _BYTE[self.fold]
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by its first word; runs may cross rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * _SLOT[j]
    return mix(out + np.uint64(size))


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """True for each word at which a run of ``size`` words of its own row starts."""
    n = int(bounds[-1])
    ok = np.zeros(max(0, n), bool)
    lengths = np.diff(bounds)
    left = np.repeat(bounds[1:], lengths) - np.arange(n)
    ok[left >= size] = True
    return ok


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row ends in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(column: pa.Array, table: np.ndarray, fold: np.ndarray | None = None) -> Iterator[Block]:
    """Cut a column into blocks of whole documents, of about ``BLOCK`` bytes."""
    data, ends = text_bytes(column)
    first, rows, powers = 0, len(ends) - 1, Powers()
    while first < rows:
        last = int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1
        last = min(rows, max(first + 1, last))
        part = ends[first : last + 1]
        yield Block(data[part[0] : part[-1]], part - part[0], first, table, fold, powers)
        first = last
