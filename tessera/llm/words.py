"""Words of whole Arrow text columns as numpy arrays: no Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds the memory of the passes below.
CHUNK = 1 << 21
#: Bytes that are hashed at once.
SEGMENT = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ , of lower-cased text.
NON_WORD = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NON_WORD[_a : _b + 1] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        made = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers[:] = made
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives memory that is free back to the system: idle workers stay, and their executor counts what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in other C libraries
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and the len + 1 bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of rows lo..hi: bounds[i]:bounds[i + 1] are those of row lo + i."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes, then a finaliser."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SEGMENT, side="right")))
            base = self.start[i]
            part = self.data[base : self.end[j - 1]].astype(np.uint64) + np.uint64(1)
            start, end = self.start[i:j] - base, self.end[i:j] - base
            up, down = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            out[i:j] = (total[end] - total[start]) * down[start]
            i = j
        return mix(out + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _split(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, separators: np.ndarray) -> Words:
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(lo, hi, data, start, end, np.searchsorted(start, offsets))


def word_chunks(column: pa.Array, separators: np.ndarray, chunk: int = CHUNK) -> Iterator[Words]:
    """Lower-cased words of consecutive rows, at most chunk bytes at once or one row."""
    raw, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1)
        data = LOWER[raw[offsets[lo] : offsets[hi]]]
        yield _split(data, offsets[lo : hi + 1] - offsets[lo], lo, hi, separators)
        lo = hi
    release()


def plain_words(text: str | None, separators: np.ndarray) -> list[bytes]:
    """The same words of one text, for small inputs and tests."""
    if not text:
        return []
    column = pa.array([text])
    return [bytes(w.data[a:b]) for w in word_chunks(column, separators) for a, b in zip(w.start, w.end, strict=True)]
