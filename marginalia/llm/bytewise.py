"""Vectorised work on the UTF-8 bytes of text columns: words, lines and hashes of runs of words.

All kernels take whole texts; slices only bound how many bytes are worked on at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker outlives its task and keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def tidied(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, after whose last batch freed memory is given back."""

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 4096:
            _powers[kind] = have
    return have


class Texts:
    """Some consecutive texts of a batch: bytes, where each text and each word starts and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SEPARATOR[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[offsets] = True
        start, end = edge[:-1] & inside, edge[1:] & inside
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.word_offsets = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, per_byte: np.ndarray, lows: np.ndarray | None = None, highs: np.ndarray | None = None) -> np.ndarray:
        """Sums of a byte flag over each text, or over given spans."""
        total = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        if lows is None:
            lows, highs = self.offsets[:-1], self.offsets[1:]
        return total[highs] - total[lows]

    def hashes(self, lows: np.ndarray, highs: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans."""
        table = _BYTE[LOWER] if lower else _BYTE
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * _power("up", _ODD, n + 1)[:n], out=total[1:])
        raw = (total[highs] - total[lows]) * _power("down", _ODD_INVERSE, n + 1)[lows]
        return mix(raw + (highs - lows).astype(np.uint64))

    def words(self, lower: bool = False) -> np.ndarray:
        return self.hashes(self.starts, self.ends, lower)

    def runs(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words inside one text, and the word at which each starts."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        valid = np.ones(n, bool)
        for j in range(1, k):
            last = self.word_offsets[1:] - j
            valid[last[(last >= 0) & (last < n)]] = False
        first = np.flatnonzero(valid)
        h = np.zeros(len(first), np.uint64)
        for j in range(k):
            h = h * _ODD + words[first + j]
        return mix(h), first

    def owner(self, word: np.ndarray) -> np.ndarray:
        """The text that each word index lies in."""
        return np.searchsorted(self.word_offsets, word, side="right") - 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) for runs of rows of about ``most`` bytes; a longer text is alone in its run."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        at = offsets[row : end + 1]
        yield row, Texts(data[at[0] : at[-1]], at - at[0])
        row = end
