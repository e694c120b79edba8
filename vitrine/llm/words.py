"""Whole Arrow text columns as flat numpy arrays of words and 64-bit hashes.

Used inside tasks, on one slice of an Arrow batch at a time: no Python object is
made per word, and memory is a fixed multiple of the slice (``slices``).
"""
from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six blank bytes: space, tab, line feed, vertical tab, form feed, return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Every ASCII byte that is no letter or digit parts tokens; bytes of other letters do not.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Text bytes worked on at once; one longer text is still worked on whole.
SLICE_BYTES = 1_000_000


def release() -> None:
    """Give free memory of a Python worker back to the system at the end of a task, for the tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        steps = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps) | np.uint64(1)


BYTE = odd(256, 11)

def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row order, cut so that the texts of a part stay near ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """``starts``/``ends``: byte span of each word; ``rows``: first word of each row, and the total."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    parting: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        first = self.starts[0]
        reach = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(first, len(self.data)) - np.repeat(self.starts, reach)
        values = np.where(self.parting, np.uint64(0), BYTE)[self.data[first:]]
        values *= odd(int(reach.max()), 23)[place]
        return mix(np.add.reduceat(values, self.starts - first) + (self.ends - self.starts).astype(np.uint64))


def split_words(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = BLANK) -> Words:
    """Words are maximal runs of bytes that do not part them, within one row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), parting)
    blank = parting[data]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    filled = offsets[:-1] < offsets[1:]
    a, b = offsets[:-1][filled], offsets[1:][filled] - 1
    first[a], last[b] = ~blank[a], ~blank[b]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets), parting)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words from each place, and whether they lie in one row."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    factors = odd(width, seed)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += hashes[j:n - width + 1 + j] * factors[j]
    whole = np.ones(n, bool)
    ends = rows[1:]
    for j in range(1, width):
        cut = ends - j
        whole[cut[(cut >= 0) & (cut >= rows[:-1])]] = False
    return mix(total), whole[:n - width + 1]
