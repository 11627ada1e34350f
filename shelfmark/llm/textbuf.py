"""Vectorised work on the bytes of Arrow string columns.

Everything takes the UTF-8 bytes of many texts at once. A word is a maximal run of ASCII
letters, digits, underscores and bytes from 0x80 up; case is folded for ASCII and for the
two-byte Latin letters.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken at once. The int64 arrays over them are some thirty times as large, in each of an executor's workers.
CHUNK = 1 << 20
WINDOW = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER_BITS = 16
with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.full(1 << _POWER_BITS, _BASE, np.uint64))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[95] = True
WORD[128:] = True


#: What empties the caches of the modules that a worker has loaded.
CACHES: list[Callable[[], None]] = []


def lean() -> None:
    """Give back what a worker keeps of other work: it serves tasks of all kinds one after another, within one bound of memory."""
    for clear in CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that each bit of the result depends on all bits of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null has no bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = values.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, values.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for U+00C0 to U+00DE."""
    out = FOLD[data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = out[at]
        up = at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        out[up] |= 0x20
    return out


def spans(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at ``starts`` as well."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[(starts > 0) & (starts < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are disjoint and in order."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    lengths = e - s
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64)
    inner = place - np.repeat(before, lengths)
    source = inner + np.repeat(s, lengths)
    inner &= (1 << _POWER_BITS) - 1
    v = _VALUE[data[source]] * _POWERS[inner]
    return mix(np.add.reduceat(v, before) + lengths.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it belongs to, in order, window by window. ``of``: the bytes that words are made of."""
    n, at = len(data), 0
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while at < n:
        to = min(at + WINDOW, n)
        while to < n and of[data[to]] and of[data[to - 1]]:
            more = np.flatnonzero(~of[data[to : to + WINDOW]])
            to = to + int(more[0]) if len(more) else min(to + WINDOW, n)
        part = data[at:to]
        lo, hi = np.searchsorted(offsets, [at, to])
        s, e = spans(of[part], offsets[lo:hi] - at)
        hashes.append(hash_spans(fold(part), s, e))
        rows.append(np.searchsorted(offsets, s + at, side="right") - 1)
        at = to
    return np.concatenate(hashes), np.concatenate(rows)


def gather(data: np.ndarray, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes (or items) of all spans, one after another."""
    before = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(s - before, lengths)]
