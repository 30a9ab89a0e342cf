"""Array views of text columns: word boundaries and 64-bit word hashes without a Python object per word.

Words are maximal runs of bytes other than space and 0x09-0x0D, which is the
same as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points because UTF-8
never uses those bytes inside a longer sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
try:
    _LIBC = ctypes.CDLL(None)
except OSError:  # no such interface
    _LIBC = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        base = np.full(size, _BASE if which == "up" else _BASE_INV, np.uint64)
        base[0] = 1
        have = np.cumprod(base)
        if size == 1 << 18:  # a longer text's are not kept
            _powers[which] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offset of each row in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns what Arrow and the allocator hold without use to the system: a worker that is reused holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_LIBC, "malloc_trim", None)) is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``limit`` bytes of ``column``, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


class Words:
    """Words of the rows of a text column: byte ``start`` and ``end``, ``row``, and ``first[r]``, the first word of row r."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.offsets = text_bytes(column)
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = ~SPACE[raw]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        edge = self.offsets[self.offsets <= n]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        after[edge] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(self.offsets)))
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        x = _BYTE[self.raw]
        x *= _power("up", len(x))
        total = np.cumsum(x)
        h = total[self.end - 1] - total[self.start] + x[self.start]
        return mix(h * _power("down", len(x))[self.start] + (self.end - self.start).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k successive word hashes; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= U(0x100000001B3)
        h += hashes[i : n + i]
    return mix(h)
