"""Vectorised text kernels over the bytes of many documents at once (numpy, no Python loop over words).

A `Block` holds some documents' UTF-8 bytes one after another, each followed by one space byte, so
that no word crosses documents. Hashes are polynomials modulo 2**64 over random byte values, taken
from prefix sums, so the hash of any byte or word range costs O(1).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that a block holds at most, besides its last document.
BLOCK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_WORD = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}

_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but the six ASCII spaces.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words after lower-casing: ASCII digits, a to z, and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        filled, step = 1, base
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * step
            step = np.uint64(int(step) ** 2 & (1 << 64) - 1)
            filled *= 2
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _MULT):
        self.base, self.n = base, len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * powers(base, self.n), out=self.sums[1:])
        self.inverse = powers(np.uint64(pow(int(base), -1, 1 << 64)), self.n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        """Of each range of `width` values, by start."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: self.n - width + 1])


class Block:
    """rows: places of its documents in the batch; bounds: byte offsets, n + 1 of them, each
    document's range including the space after it."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds

    def words(self, is_word: np.ndarray, lower: bool = True) -> Words:
        return Words(self, is_word, lower)


class Words:
    """start, end: byte ranges of the block's words; bounds: word offsets of each document, n + 1;
    hash: a 64-bit hash of each word."""

    def __init__(self, block: Block, is_word: np.ndarray, lower: bool):
        self.block = block
        self.data = data = LOWER[block.data] if lower else block.data
        inside = is_word[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]  # the block's last byte is a space
        self.bounds = np.searchsorted(self.start, block.bounds)
        self.counts = np.diff(self.bounds)
        self.bytes = RangeHash(BYTE_VALUES[data])
        self.hash = self.bytes.of(self.start, self.end)
        self._ranges: RangeHash | None = None

    @property
    def ranges(self) -> RangeHash:
        if self._ranges is None:
            self._ranges = RangeHash(self.hash, _WORD)
        return self._ranges

    def document(self) -> np.ndarray:
        """Each word's document within the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of `width` words within a document."""
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.hash))
        starts = np.flatnonzero(left >= width)
        return starts, self.ranges.of(starts, starts + width)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a string column in order, dealt into blocks; null is the empty text. A document
    is never split, so a very long one is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    first = 0
    while first < len(lengths):
        total = np.cumsum(lengths[first:] + 1)
        last = first + max(1, int(np.searchsorted(total, limit, "right")))
        n = last - first
        bounds = np.concatenate([[0], total[:n]])
        data = np.full(bounds[-1], 0x20, np.uint8)
        source = raw[offsets[first] : offsets[last]]
        if n == 1:
            data[:-1] = source
        else:
            keep = np.ones(len(data), bool)
            keep[bounds[1:] - 1] = False
            data[keep] = source
        yield Block(np.arange(first, last), data, bounds)
        first = last


def concat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .., and so on."""
    if len(start) == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) + np.repeat(start - (ends - count), count)


def arrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)
