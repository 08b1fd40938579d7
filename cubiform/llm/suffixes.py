"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Induced sorting moves through the buckets of first symbols in order. As many neighbouring buckets
as do not induce into each other are taken at once, so the interpreter works per run of buckets and
numpy per suffix, whatever the size of the alphabet; the reduced strings of the recursion, whose
alphabets are large, are sorted by the same code.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that a run of buckets has at least and at most, before it is known how far it goes.
_NARROW, _WIDE = 64, 1 << 15
#: Symbols compared by whole words before the few pairs that still agree are compared one by one.
_BY_WORDS = 512


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that follows; the last is not, unless it is the sentinel."""
    n = len(text)
    smaller = np.zeros(n, bool)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller[differs] = text[differs] < text[differs + 1]
    # Equal symbols share the class of the first that differs from its successor.
    follow = np.searchsorted(differs, np.arange(n))
    known = follow < len(differs)
    smaller[known] = smaller[differs[follow[known]]]
    smaller[-1] = True
    return smaller


def _push(order: np.ndarray, text: np.ndarray, before: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Places suffixes, given in order, at the edges of their buckets."""
    if not len(before):
        return
    symbols = text[before]
    turn = symbols.argsort(kind="stable")
    symbols, before = symbols[turn], before[turn]
    fresh = np.empty(len(symbols), bool)
    fresh[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
    first = fresh.nonzero()[0]
    used = symbols[first]
    counts = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = len(symbols) - first[-1]
    turn = np.arange(len(symbols)) - np.repeat(first, counts)
    order[np.repeat(edge[used], counts) + step * turn] = before
    edge[used] += step * counts


def _predecessors(block: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    before = block[block > 0] - 1
    return before[wanted[before]]


def _sweep(order: np.ndarray, text: np.ndarray, wanted: np.ndarray, edge: np.ndarray, bounds: np.ndarray, step: int) -> None:
    """One pass over all buckets, upwards (step 1) or downwards (step -1), placing wanted predecessors.

    order holds -1 where nothing is placed yet. bounds are the buckets' first places and the end.
    """
    n, most = len(order), _NARROW
    place = 0 if step > 0 else n
    while 0 <= place <= n and place != (n if step > 0 else 0):
        # The buckets of the next places, most of them at least.
        if step > 0:
            c = int(np.searchsorted(bounds, place, "right")) - 1
            last = max(c + 1, int(np.searchsorted(bounds, place + most, "right")) - 1)
            slots = order[place : bounds[last]]
        else:
            c = int(np.searchsorted(bounds, place, "left")) - 1
            last = min(c - 1, int(np.searchsorted(bounds, place - most, "left")))
            slots = order[bounds[last + 1] : place][::-1]
        block = slots[slots >= 0]
        before = block - 1
        some = (before >= 0) & wanted[before]
        # Upwards symbols induce none below them; a run of buckets ends before the first that it induces into.
        own, to = text[block[some]], text[before[some]]
        if len(to):
            nearest = np.minimum.accumulate(to) if step > 0 else np.maximum.accumulate(to)
            clash = (own >= nearest if step > 0 else own <= nearest).nonzero()[0]
            stop = int(nearest[clash[0]]) if len(clash) else int(nearest[-1]) if (nearest[-1] < last if step > 0 else nearest[-1] > last) else last
        else:
            stop = last
        if stop == c:
            # A bucket that induces into itself: as long as it grows.
            at = place
            while True:
                if step > 0:
                    upto = int(edge[c])
                    fresh = order[at:upto]
                else:
                    upto = int(edge[c]) + 1
                    fresh = order[upto:at][::-1]
                if not len(fresh):
                    break
                at = upto
                _push(order, text, _predecessors(fresh, wanted), edge, step)
            rest = order[at : bounds[c + 1]] if step > 0 else order[bounds[c] : at][::-1]
            _push(order, text, _predecessors(rest[rest >= 0], wanted), edge, step)
            place = int(bounds[c + 1] if step > 0 else bounds[c])
            most = _NARROW
            continue
        if len(to):
            taken = int(np.searchsorted(own, stop)) if step > 0 else int(np.searchsorted(-own.astype(np.int64), -stop))
            _push(order, text, before[some][:taken], edge, step)
        reached = int(bounds[stop] if step > 0 else bounds[stop + 1])
        most = min(max(2 * abs(reached - place), _NARROW), _WIDE)
        place = reached


def induce(text: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    order = np.full(len(text), -1, np.int32)
    symbols = text[leftmost]
    seeds = leftmost[np.argsort(symbols, kind="stable")]
    # The leftmost-smaller suffixes stand at the ends of their buckets while the larger ones are placed.
    counts = np.bincount(symbols, minlength=len(sizes))
    at = np.repeat(bounds[1:] - counts - (np.cumsum(counts) - counts), counts) + np.arange(len(seeds))
    order[at] = seeds
    larger = ~smaller
    _sweep(order, text, larger, bounds[:-1].copy(), bounds, 1)
    order[at] = -1
    order[0] = len(text) - 1  # the sentinel
    tail = bounds[1:] - 1
    tail[0] = -1
    _sweep(order, text, smaller, tail, bounds, -1)
    order[0] = len(text) - 1
    return order


def agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at places a and b, up to most, by comparing their symbols."""
    n, per = len(text), 8 // text.itemsize
    padded = np.concatenate((text, np.zeros(8, text.dtype)))
    words = np.ndarray(n + 1, np.uint64, padded, strides=(text.itemsize,))
    room = n - np.maximum(a, b)
    if most is not None:
        room = np.minimum(room, most)
    length = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    x, y, left = a.astype(np.int64), b.astype(np.int64), room.astype(np.int64)
    for done in range(0, _BY_WORDS, per):
        other = words[x] ^ words[y]
        differ = other != 0
        if differ.any():
            ends = other[differ]
            bits = np.bitwise_count((ends & (~ends + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            length[open_[differ]] = done + bits // (8 * text.itemsize)
        left -= per
        done_with = differ | (left <= 0)
        if done_with.any():
            length[open_[done_with & ~differ]] = done + per
            keep = ~done_with
            open_, x, y, left = open_[keep], x[keep], y[keep], left[keep]
        if not len(open_):
            break
        x, y = x + per, y + per
    for k, i, j in zip(open_.tolist(), x.tolist(), y.tolist()):
        same, step = 0, _BY_WORDS
        while True:
            step = min(step, n - max(i, j) - same)
            apart = np.flatnonzero(text[i + same : i + same + step] != text[j + same : j + same + step])
            if len(apart) or not step:
                same += int(apart[0]) if len(apart) else 0
                break
            same, step = same + step, 2 * step
        length[k] = same + _BY_WORDS
    return np.minimum(length, room)


def ordered(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): the substrings of size symbols at places at, in order, and which differ from the one before.

    A substring that another begins with comes after it, as its last symbol starts a smaller suffix
    and the other's starts a larger one. Symbols are compared by the word; the largest one is not used.
    """
    bits, per = 8 * text.itemsize, 8 // text.itemsize
    padded = np.zeros(len(text) + per, text.dtype.newbyteorder(">"))
    padded[: len(text)] = text
    words = np.ndarray(len(text) + 1, ">u8", padded, strides=(text.itemsize,))

    def keys(some: np.ndarray, done: int) -> np.ndarray:
        room = np.clip(size[some].astype(np.int64) - done, 0, per)
        found = words[np.minimum(at[some] + done, len(text))].astype(np.uint64)
        pad = np.array([(1 << (bits * (per - k))) - 1 for k in range(per + 1)], np.uint64)
        return found | pad[room]

    key = keys(np.arange(len(at)), 0)
    order = key.argsort()
    key = key[order]
    fresh = np.ones(len(at), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    place, done = np.arange(len(at)), per
    while True:
        # Groups that are still alike, as far as one of them goes on.
        first = np.flatnonzero(fresh[place])
        count = np.diff(np.append(first, len(place)))
        going = np.logical_or.reduceat(size[order[place]] > done, first) & (count > 1)
        if not going.any():
            return order, fresh
        place = place[np.repeat(going, count)]
        group = np.cumsum(fresh[place])
        some = order[place]
        key = keys(some, done)
        turn = np.lexsort((key, group))
        order[place], key = some[turn], key[turn]
        fresh[place[1:]] |= key[1:] != key[:-1]
        done += per


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array of symbols in 0 .. alphabet - 1 that end with a single, smallest 0."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    text = text.astype(np.uint8 if alphabet < 1 << 8 else np.uint16 if alphabet < 1 << 16 else np.uint32, copy=False)
    smaller = classify(text)
    left = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    stop = np.append(left[1:], n - 1)
    turn, fresh = ordered(text, left, stop - left + 1)
    # Substrings that are equal share a name; the string of names decides between them.
    names = np.empty(len(left), np.int64)
    names[turn] = np.cumsum(fresh) - 1
    count = int(fresh.sum())
    return induce(text, smaller, np.bincount(text, minlength=alphabet), left[turn if count == len(left) else suffix_array(names, count)])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """At each place, how long its suffix agrees with the one that precedes it in order (0 for the first).

    Where the symbols in front of both agree, too, the value is one less than that of the place in
    front; only the other places are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    own = before <= 0
    own[0] = True
    rest = np.flatnonzero(~own)
    own[rest] = text[rest - 1] != text[before[rest] - 1]
    shared = np.zeros(n, np.int64)
    compared = np.flatnonzero(own & (before >= 0))
    shared[compared] = agreement(text, compared, before[compared])
    source = np.maximum.accumulate(np.where(own, places, 0))
    return shared[source] - (places - source)


def longest_shared(pieces: list[bytes], starts: list[int]) -> np.ndarray:
    """For the first so many places of each piece, one after the other: bytes shared with another such place at most.

    Pieces are UTF-8, of whole or cut code points, so that no byte is above 0xF4.
    """
    sizes, starts = np.array([len(p) for p in pieces]), np.array(starts)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    # Symbols: 0 the sentinel, 1 the end of a piece, then bytes.
    text = np.zeros(at[-1] + 1, np.uint8)
    text[:-1] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:-1] += 2
    text[at[1:] - 1] = 1
    order = suffix_array(text, 247)
    shared = common_prefixes(text, order)
    place = np.repeat(at[:-1] - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    is_start = np.zeros(len(text), bool)
    is_start[place] = True
    # Neighbours among the starts agree as far as the least of the values between them.
    rank = np.flatnonzero(is_start[order])
    most = np.zeros(len(text), np.int64)
    if len(rank) > 1:
        between = np.minimum.reduceat(shared[order[: rank[-1] + 1]], rank[:-1] + 1)
        ordered_places = order[rank]
        most[ordered_places[1:]] = between
        most[ordered_places[:-1]] = np.maximum(most[ordered_places[:-1]], between)
    # A piece ends where the next begins.
    return np.minimum(most[place], np.repeat(at[:-1] + sizes, starts) - place)
