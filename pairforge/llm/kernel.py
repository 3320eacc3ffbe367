"""Vectorised text kernels on Arrow buffers, used inside tasks.

A *slice* is a run of whole rows of about ``SLICE_BYTES`` of text, so that
temporaries stay small however large an Arrow batch is; a longer single row
forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

#: White space of the contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Digits, lower-case letters and every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array.cast(pa.large_binary()), b"")
    array = array.cast(pa.large_binary())
    n = len(array)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give what a finished task freed back to the system, so that a reused worker keeps nothing."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Whole rows of ``batch`` in runs of about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        base = run[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(run, base + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of concatenated ranges, and where each range begins among them."""
    ends = np.cumsum(lengths)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    index = np.arange(offsets[-1], dtype=np.int64)
    index += np.repeat(starts - offsets[:-1], lengths)
    return index, offsets


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of ``word`` bytes within rows, and the offsets of each row's runs."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begin[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    end[edge] = inside[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BLOCK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below 2**16."""
    if base not in _powers:
        up, down = np.full(_BLOCK, base, _U), np.full(_BLOCK, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each range of ``values``, equal for equal ranges wherever they stand (prefix sums modulo 2**64)."""
    n = len(values)
    up, down = powers(base)
    total = np.empty(n + 1, _U)
    total[0] = 0
    total[1:] = values
    total[1:] += _U(1)
    far = [pow(base, i, 1 << 64) for i in range(0, n + 1, _BLOCK)]
    back = np.array([pow(f, -1, 1 << 64) for f in far], _U)
    for i, f in zip(range(0, n, _BLOCK), far, strict=False):
        part = total[1 + i : 1 + i + _BLOCK]
        part *= up[: len(part)]
        part *= _U(f)
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) * down[starts & (_BLOCK - 1)] * back[starts >> 16])


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(data, starts, ends)


def hash_word(word: bytes) -> int:
    """The ``word_hash`` of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hash(data, np.array([0]), np.array([len(data)]))[0])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins."""
    if not len(starts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    index, offsets = ragged(starts, ends - starts + 1)
    index[offsets[1:] - 1] = 0
    out = data[index]
    out[offsets[1:] - 1] = 0x20
    return out, offsets


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a binary array."""
    index, offsets = ragged(starts, ends - starts)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])])
