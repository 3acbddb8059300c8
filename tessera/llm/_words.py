"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is the
same as the code-point definition because UTF-8 never uses those bytes inside
a longer sequence. Words never cross rows. Equality of words is equality of
64-bit hashes; with n distinct words the chance of any collision is about
n^2 / 3.7e19 (3e-6 for ten million).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time, so that the 8-byte work arrays stay small.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_CODES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string array, nulls as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, off, data = text.buffers()
    n = len(text)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row that it belongs to. ``space``: the bytes between words."""
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets[1:], start, side="right")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range (ascending, not overlapping), mixed."""
    out = np.empty(len(start), np.uint64)
    codes = _LOWER_CODES if lower else _CODES
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _powers(max(STEP, b - a))
        with np.errstate(over="ignore"):
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum(codes[data[a:b]] * up[: b - a], out=run[1:])
            s = start[i:j] - a
            out[i:j] = mix((run[end[i:j] - a] - run[s]) * down[s] + (end[i:j] - start[i:j]).astype(np.uint64))
        i = j
    return out


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row with the total appended)."""
    data, offsets = buffers(text)
    start, end, row = bounds(data, offsets)
    return hashes(data, start, end, lower), np.searchsorted(row, np.arange(len(offsets)))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, or of the whole sequence where it is shorter; none without words."""
    if not len(h):
        return h
    n = min(k, len(h))
    size = len(h) - n + 1
    out = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out + h[i : i + size]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(31)
    return mix(out)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct values. ``np.unique`` of newer numpy fills a hash table, which takes tens of times as long as this sort."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


_REMEMBERED: list = []


def remembered(make: Callable) -> Callable:
    """``make``, whose last results stay in this worker process until a task of another kind runs there (``forget``)."""
    kept = lru_cache(maxsize=2)(make)
    _REMEMBERED.append(kept)
    return kept


def forget() -> None:
    """Drop what ``remembered`` functions keep: a worker process serves the tasks of all operators in turn."""
    for kept in _REMEMBERED:
        kept.cache_clear()


def give_back() -> None:
    """Return freed memory to the system: an idle worker between tasks holds none for later."""
    if _POWERS and len(_POWERS[0]) > STEP:  # of a very long word
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slabs(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most about ``most`` bytes of text; a longer text stands alone.

    ``keep``: the task itself uses what is ``remembered``.
    """
    if not keep:
        forget()
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        i = 0
        while i < len(total):
            before = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(i, j - i)
            i = j
    give_back()
