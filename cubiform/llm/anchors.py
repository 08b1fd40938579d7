"""Content-defined anchors: where equal long strings are sure to meet.

Every string of `least` bytes has grams at `least - gram + 1` places; the one with the smallest hash
(the last of equals) is its anchor, so equal strings have equal anchors at equal distances. The
starts that share an anchor form a run.
"""

from __future__ import annotations

import numpy as np

from . import textcore as tc

U64 = np.uint64


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width neighbours, from prefix and suffix minima of blocks of width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _least_grams(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, hash): for each string of least bytes, where the gram with the smallest hash begins; and all grams' hashes."""
    total = tc.running(data)
    ends = np.arange(gram, len(data) + 1)
    grams = tc.spans(total, ends - gram, ends)
    bits = U64(int(len(data)).bit_length())
    mask = (U64(1) << bits) - U64(1)
    packed = (grams & ~mask) | (mask - np.arange(len(grams), dtype=U64))
    best = window_least(packed, least - gram + 1)
    return (mask - (best & mask)).astype(np.int64), grams


def _edges(wanted: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the runs of wanted starts that share an anchor."""
    fresh, last = wanted.copy(), wanted.copy()
    change = anchor[1:] != anchor[:-1]
    fresh[1:] &= ~wanted[:-1] | change
    last[:-1] &= ~wanted[1:] | change
    return np.flatnonzero(fresh), np.flatnonzero(last)


def runs(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(low, high, at, key): each run's first and last start, its anchor's place and hash. Strings never leave a document."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none.view(U64)
    anchor, grams = _least_grams(data, least, gram)
    inside = np.zeros(len(anchor) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= least)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, np.minimum(offsets[long + 1] - least + 1, len(anchor)), -1)
    low, high = _edges(np.cumsum(inside[:-1]) > 0, anchor)
    return low, high, anchor[low], grams[anchor[low]]


def contexts(data: np.ndarray, first: np.ndarray, end: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(low, high, key, context) of the runs of the starts in the half-open ranges of one document.

    The context is a hash of all bytes of the run's strings, with the anchor's place in it.
    """
    none = np.zeros(0, np.int64)
    if len(data) < least or not len(first):
        return none, none, none.view(U64), none.view(U64)
    anchor, grams = _least_grams(data, least, gram)
    low, high = _edges(tc.covered(first, end, len(anchor)), anchor)
    at = anchor[low]
    body = tc.spans(tc.running(data), low, high + least)
    return low, high, grams[at], tc.mix(body + (at - low).astype(U64) * U64(0x9E3779B97F4A7C15) + (high - low).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
