"""Texts of an Arrow batch as flat numpy arrays: words, lines, windows and their hashes.

All functions work on a slice of documents at once, so no Python code runs per word. Hashes
are 64 bits wide; two different strings agree with a chance of about 5e-20.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from relaymill.llm import per_process

SLICE_BYTES = 1 << 20

# The word separators of the contracts: space and the bytes 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
_BYTE_VALUES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_table(base: int, size: int) -> np.ndarray:
    usual = 2 * SLICE_BYTES
    if size > usual:  # that of a giant document is not kept
        return _powers(base, size)
    return per_process.kept(f"powers:{base}", lambda: _powers(base, usual))[:size]


def released() -> None:
    """Give freed memory back to the machine: a worker lives on between its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Slice:
    """Some consecutive documents: bytes, and where each document starts and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def lower(self) -> Slice:
        """The same with A to Z in lower case."""
        return Slice(_LOWER[self.data], self.offsets)

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each document."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes within a document: starts, ends, runs per document."""
        size = len(inside)
        edges = np.zeros(size + 1, dtype=bool)
        edges[1:-1] = inside[1:] != inside[:-1]
        edges[self.offsets] = True
        cuts = np.flatnonzero(edges)
        if size == 0 or len(cuts) < 2:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(self.n, dtype=np.int64)
        starts, ends = cuts[:-1], cuts[1:]
        marked = inside[starts]
        starts, ends = starts[marked], ends[marked]
        first = np.searchsorted(starts, self.offsets)
        return starts, ends, np.diff(first)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~IS_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range."""
        size = len(self.data)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * _power_table(_BASE, size), out=sums[1:])
        found = (sums[ends] - sums[starts]) * _power_table(_INVERSE, size + 1)[starts]
        return mix(found ^ (ends - starts).astype(np.uint64))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Slice]]:
    """Cut an Arrow text column into runs of whole documents of about `limit` bytes.

    A null counts as an empty text. A longer document makes a slice of its own.
    """
    text = text.cast(pa.large_utf8()) if not pa.types.is_large_string(text.type) else text
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offset_buffer, data_buffer = text.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        part = offsets[at : end + 1]
        yield at, end, Slice(data[part[0] : part[-1]], part - part[0])
        at = end
    released()


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words that lie within one document.

    Returns the hash of each window and the index of its first word; the windows come in
    the order of the words.
    """
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = len(hashes) - width + 1
    out = hashes[:total].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + total]
    document = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(document[:total] == document[width - 1 :])
    return mix(out[whole]), whole


def owners(counts: np.ndarray) -> np.ndarray:
    """The document index of each of the counted things."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)
