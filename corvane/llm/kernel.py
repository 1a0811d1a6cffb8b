"""Vectorised text kernels over Arrow string columns.

Every kernel works on the UTF-8 bytes of a block of whole texts.  Separators
are ASCII, so byte classes never cut a code point.  A block is bounded in
bytes; one text is never split, so the bound holds up to the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one block holds at most, unless one text is longer.
BLOCK_BYTES = 2 << 20

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for low, high in separators:
        inside[low : high + 1] = False
    return inside


#: Words are runs of bytes outside white space.
BLANK_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and all code points above 0x7F.
ALNUM_WORDS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block of texts: byte bounds, 64-bit hashes, and for each text the range of its words."""

    __slots__ = ("low", "offsets", "start", "end", "hash", "first")

    def __init__(self, low: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.low, self.offsets = low, offsets
        n = int(offsets[-1])
        mask = inside[low[:n]]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = mask[:-1]
            after[:-1] = mask[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hash_spans(low, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def hash_spans(padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``padded`` has eight spare bytes at its end."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    x = eight[start] & _LOW_BYTES[np.minimum(length, 8)]
    out = mix(x ^ (length.astype(np.uint64) * _M2))
    todo, done = np.flatnonzero(length > 8), 8
    while len(todo):
        x = eight[start[todo] + done] & _LOW_BYTES[np.minimum(length[todo] - done, 8)]
        out[todo] = mix(out[todo] * _M3 ^ x)
        done += 8
        todo = todo[length[todo] > done]
    return out


def hash_word(word: bytes) -> int:
    padded = np.frombuffer(word + bytes(8), dtype=np.uint8)
    return int(hash_spans(padded, np.array([0]), np.array([len(word)]))[0])


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column, inside: np.ndarray, lower: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Yields (first row, row after the last, Words) for bounded runs of rows."""
    for a, b, low, offsets in byte_blocks(column, lower, block_bytes):
        yield a, b, Words(low, offsets, inside)


def byte_blocks(column, lower: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes with eight spare, offsets)."""
    data, offsets = text_bytes(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + block_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        low = np.zeros(int(offsets[b] - offsets[a]) + 8, dtype=np.uint8)
        piece = data[offsets[a] : offsets[b]]
        low[:-8] = LOWER[piece] if lower else piece
        yield a, b, low, offsets[a : b + 1] - offsets[a]
        a = b


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and its length."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return start, np.diff(np.append(start, len(sorted_values)))


def tidy(run: Callable) -> Callable:
    """The same mapInArrow function; when a task ends, its freed memory goes back to the system, as workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped
