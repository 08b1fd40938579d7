"""Array kernels over UTF-8 text buffers: words, word hashes, n-gram hashes.

Everything here works on the concatenated bytes of many documents at once, so a Python worker
spends its time inside numpy, and never builds a string per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Most text bytes that one round of array work takes, unless a single document is longer.
SLICE_BYTES = 1 << 19


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words between white space (space and \\x09-\\x0D), as a table over bytes.
SPACED = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of alphanumeric words: digits, letters and everything outside ASCII.
ALNUM = _class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on arrays."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_GOLDEN = U64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    BYTE_VALUES = mix((np.arange(256, dtype=U64) + U64(1)) * _GOLDEN)
    LANE_VALUES = (BYTE_VALUES, mix(BYTE_VALUES ^ _GOLDEN))
_BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)
_BASE = _BASES[0]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if lane not in _powers or len(_powers[lane][0]) <= n:
        size, made = max(n + 1, SLICE_BYTES + 1), []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _powers[lane] = (made[0], made[1])
    return _powers[lane]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of SLICE_BYTES at most (or one longer document): first, end, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each document's words begin (n + 1 entries)."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def running(data: np.ndarray, lane: int = 0) -> np.ndarray:
    """The polynomial prefix sums from which spans() takes hashes; lane 1 has another base and other values."""
    up, _ = powers(len(data), lane)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(LANE_VALUES[lane][data] * up[: len(data)], out=total[1:])
    return total


def spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    _, down = powers(len(total), lane)
    return mix((total[ends] - total[starts]) * down[starts])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one polynomial prefix sum."""
    return spans(running(data), starts, ends)


def ngrams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each first word; windows over a document's end included."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for k in range(n):
        total = total * U64(_BASE) + word_hashes[k : k + count]
    return mix(total)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of size places lie in any of the half-open ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:-1] > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80
