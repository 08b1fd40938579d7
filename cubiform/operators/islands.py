"""A generation of one island for each of many scenes of boxes, in numpy: what search.founders and search.evolve make of them.

Every scene draws the same numbers, but not as many of them, so each has its place in the stream. A candidate is run, made
exact, written, read back and compared, many at once. Scenes with anything unusual are odd and left to search.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..sources import batches as B
from ..sources import programs as P
from .random import ChaCha8
from .search import SearchConfig
from .variation import APPENDED, MUTATIONS

#: A command is a row of small numbers, and what is behind the last command is zero; a to g are by kind.
_NAMES = {
    "box": "material ox oy oz sx sy sz", "run": "material ox oy oz axis length", "wall": "material ox oy oz axis u v thickness", "extrude": "material ox oy oz axis u v depth",
    "repeat_box": "material ox oy oz sx sy sz dx dy dz count", "mirror": "material ox oy oz sx sy sz px py pz axis", "gable": "material ox oy oz width depth style z_oriented",
}
#: One more than the code in the format.
_OP = {name: 1 + B._CODES[name] for name in _NAMES}
_WIDE = 12
_MATERIAL, _AT, _SIZE, _DELTA, _COUNT = 1, slice(2, 5), slice(5, 8), slice(8, 11), 11
#: Scenes bred at once, programs run at once, commands of a scene and what they write.
_SCENES, _RUN, _COMMANDS, _WRITES = 4096, 512, 40, 1 << 14
_TANGENTS = np.array(P.TANGENTS)


class Draws:
    """ChaCha8 for many scenes: the words of one stream, and where each scene is in it."""

    def __init__(self, config: SearchConfig, stream: int, generation: int, scenes: int, words: int):
        rng = ChaCha8.seeded(config.seed, stream, generation)
        self.words, self.at = np.array([rng.u32() for _ in range(words)], np.uint64), np.zeros(scenes, np.int64)

    def u32(self, who: np.ndarray) -> np.ndarray:
        self.at[who] += 1
        return self.words[self.at[who] - 1]

    def below(self, who: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.int64), who.shape)
        found, some = np.zeros(len(who), np.int64), np.flatnonzero(n > 1)
        if len(some):
            at = self.at[who[some]]
            found[some] = ((self.words[at] | self.words[at + 1] << np.uint64(32)) % n[some].astype(np.uint64)).astype(np.int64)
            self.at[who[some]] += 2
        return found


# ---- how programs vary, see variation.py ---------------------------------------------------

_Ops = tuple[np.ndarray, np.ndarray]


def _moved(ops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each program's commands from these places."""
    whole = np.ascontiguousarray(ops).view(f"V{2 * _WIDE}")[:, :, 0]
    return whole[np.arange(len(at))[:, None], at].view(np.int16).reshape(*at.shape, _WIDE)


def _kept(ops: np.ndarray, keep: np.ndarray) -> _Ops:
    """The commands to keep, moved together."""
    n = keep.sum(1)
    ops = _moved(ops, np.argsort(~keep, axis=1, kind="stable"))
    ops[np.arange(ops.shape[1]) >= n[:, None]] = 0
    return ops, n


def _without(ops: np.ndarray, n: np.ndarray, i: np.ndarray) -> _Ops:
    place = np.arange(ops.shape[1])
    return _kept(ops, (place < n[:, None]) & (place != i[:, None]))


def _keys(ops: np.ndarray, first: int, last: int) -> np.ndarray:
    """These numbers of each command in one; they must be below 512, above -512."""
    key = np.zeros(ops.shape[:2], np.int64)
    for k in range(first, last):
        key = key * 1024 + (ops[:, :, k] + 512)
    return key


def _distinct(ops: np.ndarray, n: np.ndarray) -> _Ops:
    several = ops.shape[1]
    same = np.ones((len(ops), several, several), bool)
    for first, last in ((0, 6), (6, _WIDE)):
        key = _keys(ops, first, last)
        same &= key[:, :, None] == key[:, None, :]
    again = (same & np.tri(several, k=-1, dtype=bool)).any(2)
    return _kept(ops, ~again & (np.arange(several) < n[:, None]))


def _boxes_to_repeat(ops: np.ndarray, n: np.ndarray) -> _Ops:
    several, box = ops.shape[1], ops[:, :, 0] == _OP["box"]
    what, where = _keys(np.delete(ops, _AT, 2), 1, 5), _keys(ops, 2, 5)
    pairs = (what[:, :, None] == what[:, None, :]) & (where[:, :, None] != where[:, None, :]) & box[:, :, None] & box[:, None, :] & ~np.tri(several, dtype=bool)
    flat = pairs.reshape(len(ops), several * several)
    some = np.flatnonzero(flat.any(1))
    i, j = np.divmod(flat[some].argmax(1), several)
    ops, n = ops.copy(), n.copy()
    ops[some, i, 0], ops[some, i, _DELTA], ops[some, i, _COUNT] = _OP["repeat_box"], ops[some, j, _AT] - ops[some, i, _AT], 2
    ops[some], n[some] = _without(ops[some], n[some], j)
    return ops, n


def _spliced(a: _Ops, b: _Ops, draws: Draws, who: np.ndarray) -> _Ops:
    (first, n), (second, m) = a, b
    stop = draws.below(who, n + 1)
    start = draws.below(who, m + 1)
    place = np.arange(first.shape[1])
    return _kept(np.concatenate([first, second], 1), np.concatenate([place < stop[:, None], (place >= start[:, None]) & (place < m[:, None])], 1))


def _appended(kind: str, draws: Draws, who: np.ndarray, palettes: tuple[np.ndarray, np.ndarray], size: tuple[int, int, int]) -> np.ndarray:
    row = np.zeros((len(who), _WIDE), np.int16)
    row[:, 0] = _OP[kind]
    extent = [1 + draws.below(who, min(s, 8)) for s in size]
    row[:, _AT] = np.stack([draws.below(who, s - e + 1) for s, e in zip(size, extent)], 1)
    for _ in range(3):
        draws.below(who, 17)
    material = palettes[0][who, draws.below(who, palettes[1][who])]
    if kind == "gable":
        style = draws.below(who, 3)
        row[:, 1], row[:, 5:9] = material, np.stack([extent[0], extent[2], style, draws.below(who, 2)], 1)
    else:
        row[:, _SIZE], row[:, _DELTA], row[:, _COUNT] = np.stack(extent, 1), row[:, _AT], draws.below(who, 3)
    return row


def mutate(kind: str, ops: np.ndarray, n: np.ndarray, draws: Draws, who: np.ndarray, palettes: tuple[np.ndarray, np.ndarray], size: tuple[int, int, int]) -> _Ops | None:
    """variation.mutate of these scenes' programs by one kind of change; None for a kind that isn't here."""
    if kind in APPENDED and kind not in ("gable", "mirror"):
        return None
    ops, n = ops.copy(), n.copy()
    some = np.arange(len(n)) if kind in APPENDED else np.flatnonzero(n)
    i = draws.below(who[some], n[some])
    if kind == "remove":
        ops[some], n[some] = _without(ops[some], n[some], i)
    elif kind == "swap":
        j = draws.below(who[some], n[some])
        ops[some, i], ops[some, j] = ops[some, j], ops[some, i]
    elif kind in ("combine", "repeat"):
        return _boxes_to_repeat(ops, n)
    elif kind in APPENDED:
        ops[some, n] = _appended(kind, draws, who, palettes, size)
        n += 1
    elif kind == "fewer":
        again = ops[some, i, 0] == _OP["repeat_box"]
        some, i = some[again], i[again]
        ops[some, i, _COUNT] = np.maximum(2, ops[some, i, _COUNT] - 1)
    else:
        box = ops[some, i, 0] == _OP["box"]
        some, i = some[box], i[box]
        row = ops[some, i]
        extent = row[:, _SIZE].astype(np.int64)
        if kind == "thin":
            thin = extent == 1
            several, plain = thin.sum(1), np.where(thin.all(1), 0, (~thin).argmax(1))
            line, wall, made = several >= 2, several == 1, row.copy()
            axis = np.where(line, plain, thin.argmax(1))
            made[:, 5:] = 0
            made[:, 5] = axis
            made[:, 6] = np.where(line, extent[np.arange(len(axis)), axis], extent[np.arange(len(axis)), _TANGENTS[axis, 0]])
            made[wall, 7], made[wall, 8] = extent[wall, _TANGENTS[axis[wall], 1]], 1
            made[:, 0] = np.where(line, _OP["run"], _OP["wall"])
            ops[some, i] = np.where((several > 0)[:, None], made, row)
        elif kind == "split":
            wide = extent > 1
            some, i, row, extent, wide = (c[wide.any(1)] for c in (some, i, row, extent, wide))
            pick = draws.below(who[some], wide.sum(1))
            axis = ((np.cumsum(wide, 1) == pick[:, None] + 1) & wide).argmax(1)
            each = np.arange(len(some))
            at = 1 + draws.below(who[some], extent[each, axis] - 1)
            low, high = row.copy(), row.copy()
            low[each, 5 + axis], high[each, 5 + axis] = at, extent[each, axis] - at
            high[each, 2 + axis] += at.astype(np.int16)
            place = np.arange(ops.shape[1])
            ops[some] = _moved(ops[some], place - (place > i[:, None]))
            ops[some, i], ops[some, i + 1] = low, high
            n[some] += 1
        else:
            axis, each = draws.below(who[some], 3), np.arange(len(some))
            if kind == "shrink":
                row[each, 5 + axis] = np.maximum(1, extent[each, axis] - 1)
            else:
                row[:, 0] = _OP["extrude"]
                row[:, 5:9] = np.stack([axis, extent[each, _TANGENTS[axis, 0]], extent[each, _TANGENTS[axis, 1]], extent[each, axis]], 1)
            ops[some, i] = row
    return ops, n


# ---- candidates made exact -----------------------------------------------------------------


def _table(ops: np.ndarray, n: np.ndarray, size: tuple[int, int, int]) -> B.Table:
    rows = ops[np.arange(ops.shape[1]) < n[:, None]].astype(np.int64)
    cols = {c: np.zeros(len(rows), np.int64) for c in B._COLUMNS}
    cols["op"] = rows[:, 0] - 1
    for name, fields in _NAMES.items():
        at = np.flatnonzero(rows[:, 0] == _OP[name])
        for k, field in enumerate(fields.split()):
            cols[field][at] = rows[at, 1 + k]
        if name == "mirror":
            cols["material"][at] = B._NONE
        elif name == "extrude":
            area = rows[at, 6] * rows[at, 7]
            cols["mask"][at], cols["mask_n"][at] = (1 << np.minimum(area, B._MASK)) - 1, area
    odd = np.zeros(len(n), bool)
    odd[np.repeat(np.arange(len(n)), n)[cols["mask_n"] > B._MASK]] = True
    return B.Table(np.concatenate([[0], np.cumsum(n)]), np.tile(np.array(size, np.int64), (len(n), 1)), cols, odd)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of them each of so many is of, and the how manieth of it."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - (np.cumsum(counts) - counts)[whose]


def _cells(program: np.ndarray, box: np.ndarray, size: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(box, key) of the cells of boxes (x, y, z, w, h, d), box by box; a key is a program's cell."""
    x, y, z, w, h, d = box.astype(np.int32)
    lines = h * d
    whose = np.repeat(np.arange(len(lines), dtype=np.int32), lines)
    i = np.arange(len(whose), dtype=np.int32) - np.repeat((np.cumsum(lines) - lines).astype(np.int32), lines)
    deep = d[whose]
    up = i // deep
    begin = ((program * (size[0] * size[1] * size[2])).astype(np.int32) + x + size[0] * (z + size[2] * y))[whose] + size[0] * (i + up * (size[2] - deep))
    wide = w[whose]
    at = np.repeat(whose, wide)
    return at, np.repeat(begin - (np.cumsum(wide) - wide).astype(np.int32), wide) + np.arange(len(at), dtype=np.int32)


def _once(keys: np.ndarray) -> np.ndarray:
    """The different keys in order."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _draw(t: B.Table, space: np.ndarray, size: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws programs into the empty space: the keys that were written, the writes of each program, and which fail."""
    n, program, volume = len(t.odd), t.programs(), size[0] * size[1] * size[2]
    step, boxes = np.arange(len(program)) - t.starts[program], B._boxes(t)
    failed, whole = np.zeros(n, bool), np.array(size)[:, None]
    outside = ((boxes[5:8] < 1) | (boxes[2:5] < 0) | (boxes[2:5] + boxes[5:8] > whole)).any(0)
    failed[program[boxes[0, outside]]] = True
    boxes = boxes[:, ~failed[program[boxes[0]]]]
    boxes = boxes[:, np.argsort(step[boxes[0]], kind="stable")]
    writes = np.bincount(program[boxes[0]], boxes[5:8].prod(0), n).astype(np.int64)
    whose, keys = _cells(program[boxes[0]], boxes[2:], size)
    painted, order = boxes[1].astype(np.uint8)[whose], step[boxes[0]]
    ends = np.searchsorted(whose, np.searchsorted(order, np.arange(int(step.max(initial=-1)) + 2)))
    touched, moved = [keys], t.cols["op"] == B._CODES["mirror"]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        space[keys[a:b]] = painted[a:b]  # a command's boxes have one material
        rows = np.flatnonzero(moved & (step == k))
        rows = rows[~failed[program[rows]]]
        if len(rows):
            at, extent, target = (np.stack([t.cols[c][rows] for c in B._VECTORS[v]]) for v in ("source", "size", "target"))
            bad = ((extent < 1) | (at < 0) | (at + extent > whole) | (target < 0) | (target + extent > whole)).any(0)
            failed[program[rows[bad]]] = True
            rows, at, extent, target = rows[~bad], at[:, ~bad], extent[:, ~bad], target[:, ~bad]
            of, source = _cells(program[rows], np.concatenate([at, extent]), size)
            material = space[source]
            full = np.flatnonzero(material)
            of, source, material = of[full], source[full] % volume, material[full]
            count = np.bincount(of, minlength=len(rows))
            failed[program[rows[count == 0]]] = True
            writes[program[rows]] += count
            v = [c - a[of] for c, a in zip((source % size[0], source // (size[0] * size[2]), source // size[0] % size[2]), at)]
            axis = t.cols["axis"][rows][of]
            x, y, z = (g[of] + np.where(axis == q, e[of] - 1 - c, c) for q, (g, e, c) in enumerate(zip(target, extent, v)))
            to = (program[rows][of] * volume + x + size[0] * (z + size[2] * y)).astype(np.int32)
            space[to] = material
            touched.append(to)
    return np.concatenate(touched), writes, failed


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bytes of each varint, below 1 << 28."""
    return 1 + (v >= 1 << 7) + (v >= 1 << 14) + (v >= 1 << 21)


def _rows(*tokens) -> np.ndarray:
    """The tokens of elements, below zero where there is none."""
    return np.stack(np.broadcast_arrays(*tokens), 1)


def residuals(n: int, whose: np.ndarray, ids: np.ndarray, kind: np.ndarray, index: np.ndarray, size: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, lengths, odd): for each of n programs the smallest residual of its patches, by program and id, as programs.residuals has it.

    Odd are programs with one that isn't in a list: a bitmap of layers or of everything.
    """
    count, sx, area = np.bincount(whose, minlength=n), size[0], size[0] * size[2]
    act = np.where(kind == 1, -1, index)
    new = np.diff(whose, prepend=-1) != 0
    gap = np.where(new, ids, np.diff(ids, prepend=0) - 1)
    other = new | (gap > 0) | (np.diff(kind, prepend=-1) != 0) | (np.diff(act, prepend=-2) != 0)

    def stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(starts)
        return at, np.diff(at, append=len(ids))

    runs, long = stretches(other)
    end = np.where(new[runs], 0, (ids + 1)[runs - 1])
    boxes, wide = stretches(other | (ids % sx == 0))
    group = (whose * 4 + kind) * 256 + index * (kind != 1)
    order = np.argsort(group, kind="stable")
    first = np.diff(group[order], prepend=-1) != 0
    heads, members = stretches(first)
    inner = np.where(first, ids[order], np.diff(ids[order], prepend=0) - 1)
    length = np.zeros(len(ids), np.int64)
    length[heads] = members
    none = np.where(first, 0, -1)
    b = boxes
    listed = [
        (whose, _rows(gap, kind, act)), (whose[runs], _rows(ids[runs] - end, long - 1, kind[runs], act[runs])),
        (whose[b], _rows(ids[b] % sx, ids[b] // area, ids[b] // sx % size[2], wide - 1, 0, 0, kind[b], act[b])),
        (whose[order], _rows(np.where(first, kind[order], -1), np.where(first, act[order], -1), np.where(first, length, none), inner)),
    ]
    entries = [count, np.bincount(whose[runs], minlength=n), np.bincount(whose[b], minlength=n), np.bincount(whose[order[heads]], minlength=n)]
    took = np.stack([1 + _sizes(e) + np.bincount(w, np.where(t >= 0, _sizes(t), 0).sum(1), n).astype(np.int64) for (w, t), e in zip(listed, entries)])
    best = took.argmin(0)
    least, odd = took.min(0), np.zeros(n, bool)
    odd |= (count > 0) & (least >= 1 + size[1] * area // 8)
    many = (count > 0) & (least >= 2 + -(-area // 8))
    if many.any():
        mine = many[whose]
        layers = np.unique(((whose * size[1] + ids // area) * 4 + kind)[mine] * 256 + (index * (kind != 1))[mine])
        layered = np.bincount(layers // (1024 * size[1]), minlength=n)
        odd |= many & (1 + layered * (2 + -(-area // 8)) <= least)
    parts, owners = [np.zeros((n, 8), np.int64) - 1], [np.arange(n)]
    parts[0][:, 0] = np.where(count, np.array([1, 2, 3, 6])[best], 0)
    parts[0][:, 1] = np.where(count, np.choose(best, entries), -1)
    for k, (w, t) in enumerate(listed):
        mine = best[w] == k
        owners.append(w[mine])
        parts.append(np.pad(t[mine], ((0, 0), (0, 8 - t.shape[1])), constant_values=-1))
    owner, tokens = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    owner, tokens = owner[order], tokens[order]
    lit = tokens >= 0
    owner, tokens = np.repeat(owner, lit.sum(1)), tokens[lit]
    lengths = _sizes(tokens)
    stops = np.cumsum(lengths)
    out, at = np.zeros(int(lengths.sum()), np.uint8), stops - lengths
    for k in range(4):
        long = lengths > k
        out[at[long] + k] = tokens[long] >> 7 * k & 127 | np.where(lengths[long] > k + 1, 128, 0)
    return out, np.bincount(owner, lengths, n).astype(np.int64), odd


def read_residuals(data: np.ndarray, lengths: np.ndarray, size: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """(program, id, kind, palette index or -1) that residuals in lists hold, one behind the other, by program and id; and which aren't read to their ends."""
    n, (sx, _, sz) = len(lengths), size
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    tokens = np.zeros(len(last) + 8, np.int64)
    for k in range(4):
        long = np.flatnonzero(last - begin >= k)
        tokens[long] |= (data[begin[long] + k].astype(np.int64) & 127) << 7 * k
    stop = np.cumsum(lengths)
    place, stop = np.searchsorted(begin, stop - lengths), np.searchsorted(begin, stop)
    end = len(tokens) - 1
    found: list[tuple[np.ndarray, ...]] = []

    def take(who: np.ndarray) -> np.ndarray:
        place[who] += 1
        return tokens[np.minimum(place[who] - 1, end)]

    def action(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, index = take(who), np.full(len(who), -1)
        painted = kind != 1
        index[painted] = take(who[painted])
        return kind, index

    every = np.arange(n)
    tag = take(every)
    some = np.flatnonzero((tag > 0) & (lengths > 0))
    count, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count[some] = take(some)
    odd = ~np.isin(tag, (0, 1, 2, 3, 6))
    count[odd] = 0
    for step in range(int(count.max(initial=0))):
        going = np.flatnonzero(count > step)
        if not len(going):
            break
        for code in (1, 2, 3, 6):
            who = going[tag[going] == code]
            if not len(who):
                continue
            if code == 1:
                start = at[who] + take(who) + (step > 0)
                found.append((who, start, *action(who)))
                at[who] = start
            elif code == 6:
                kind, index = action(who)
                held = np.minimum(take(who), end)
                of, i = _spread(held)
                gap = tokens[np.minimum(place[who][of] + i, end)]
                place[who] += held
                total = np.cumsum(gap + 1)
                before = np.concatenate([[0], total])[np.cumsum(held) - held]
                found.append((who[of], total - before[of] - 1, kind[of], index[of]))
            else:
                if code == 2:
                    start = at[who] + take(who)
                    long = take(who) + 1
                    at[who] = start + long
                else:
                    x, y, z = take(who), take(who), take(who)
                    start, long = x + sx * (z + sz * y), take(who) + 1
                    odd[who] |= (take(who) != 0) | (take(who) != 0)
                kind, index = action(who)
                of, i = _spread(np.minimum(long, 1 << 20))
                found.append((who[of], start[of] + i, kind[of], index[of]))
            count[who[place[who] > stop[who]]] = 0
    odd |= place != stop
    whose, ids, kind, index = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.argsort(whose * (1 << 32) + ids, kind="stable")
    return whose[order], ids[order], kind[order], index[order], odd


class Scenes:
    """Targets, and the candidates that draw them."""

    def __init__(self, ops: np.ndarray, n: np.ndarray, palettes: tuple[np.ndarray, np.ndarray], size: tuple[int, int, int], space: np.ndarray):
        self.palettes, self.size, self.space, self.volume = palettes, size, space, size[0] * size[1] * size[2]
        self.odd = np.zeros(len(n), bool)
        ids, materials, counts = [], [], []
        for first in range(0, len(n), _RUN):
            part = slice(first, first + _RUN)
            touched, _, failed = _draw(_table(ops[part], n[part], size), space, size)
            self.odd[part] |= failed
            keys = _once(touched)
            ids.append(keys % self.volume)
            materials.append(space[keys])
            counts.append(np.bincount(keys // self.volume, minlength=len(n[part])))
            space[touched] = 0
        self.ids, self.materials, self.counts = np.concatenate(ids), np.concatenate(materials), np.concatenate(counts)
        self.begins = np.cumsum(self.counts) - self.counts

    def _patches(self, t: B.Table, scene: np.ndarray) -> tuple[np.ndarray, ...]:
        """Patches (program, id, kind, palette index) by program and id, writes, and which programs fail, of some programs.

        Programs whose patches don't make the target of what is drawn are odd.
        """
        found, writes, failed = [], [], []
        for first in range(0, len(scene), _RUN):
            mine = scene[first : first + _RUN]
            touched, made, bad = _draw(t.part(first, first + len(mine)), self.space, self.size)
            of, i = _spread(self.counts[mine])
            at = self.begins[mine][of] + i
            keys, wanted = (of * self.volume + self.ids[at]).astype(np.int32), self.materials[at]
            have = self.space[keys]
            wrong = np.flatnonzero(have != wanted)
            self.space[keys] = 0
            more = _once(touched[self.space[touched] != 0])
            self.space[touched] = 0
            key = np.concatenate([keys[wrong], more])
            kind = np.concatenate([np.where(have[wrong] == 0, 0, 2), np.ones(len(more), np.int64)])
            material = np.concatenate([wanted[wrong], np.zeros(len(more), np.uint8)])
            order = np.argsort(key)
            whose = (key // self.volume)[order]
            keep = ~bad[whose]
            found.append(((whose[keep] + first).astype(np.int64), (key % self.volume)[order][keep].astype(np.int64), kind[order][keep], material[order][keep].astype(np.int64)))
            writes.append(made)
            failed.append(bad)
        return *(np.concatenate(c) for c in zip(*found)), np.concatenate(writes), np.concatenate(failed)

    def evaluate(self, scene: np.ndarray, ops: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], bytes]]:
        """(valid, bytes, units, encoding) of programs made exact; each is read back, and one that differs makes its scene odd."""
        t = _table(ops, n, self.size)
        whose, ids, kind, material, writes, failed = self._patches(t, scene)
        valid, total, units = ~failed, np.zeros(len(n), np.int64), writes + n + 2 * np.bincount(whose, minlength=len(n))
        left = np.flatnonzero(valid)
        place = np.cumsum(valid) - 1
        odd, total[left], data = self._written(t.some(valid), scene[left], (place[whose], ids, kind, material))
        self.odd[scene[left[odd]]] = True
        valid[left[odd]] = False
        stops = np.cumsum(total).tolist()
        return valid, total, units, lambda p: data[stops[p] - total[p] : stops[p]]

    def _written(self, t: B.Table, scene: np.ndarray, sent: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(odd, lengths, bytes) of programs with their patches; odd ones are not read back as they were sent."""
        (whose, ids, kind, material), n, (palette, several) = sent, len(scene), self.palettes
        index = (palette[scene][whose] < material[:, None]).sum(1)
        body, lengths, odd = residuals(n, whose, ids, kind, index, self.size)
        of, i = _spread(several[scene])
        head, wrong = B.encode(t, (of, palette[scene][of, i]))
        odd |= wrong | t.odd
        offsets = np.frombuffer(head.buffers()[1], np.int32)[: n + 1].astype(np.int64)
        written = np.diff(offsets) - 1
        total = written + lengths
        ends = np.cumsum(total)
        out = np.zeros(int(total.sum()), np.uint8)
        of, i = _spread(written)
        out[(ends - total)[of] + i] = np.frombuffer(head.buffers()[2], np.uint8)[offsets[:-1][of] + i]
        of, i = _spread(lengths)
        out[(ends - lengths)[of] + i] = body
        content = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)])
        # The same commands run the same way, and the same patches make the target of what they draw.
        again, where, colours = B.commands(content)
        odd |= again.odd | (where != written) | (np.diff(again.starts) != np.diff(t.starts))
        odd |= _differ(again.programs(), t.programs(), [(again.cols[c], t.cols[c]) for c in B._COLUMNS], odd)
        whole = np.where(odd, 0, total - where)
        of, i = _spread(whole)
        read = read_residuals(out[(ends - total + where)[of] + i], whole, self.size)
        held = np.where(read[3] < 0, 0, colours[read[0], np.clip(read[3], 0, colours.shape[1] - 1)])
        odd |= read[4] | (np.bincount(read[0], minlength=n) != np.bincount(whose, minlength=n))
        odd |= _differ(read[0], whose, [(read[1], ids), (read[2], kind), (held, material)], odd)
        return odd, total, out.tobytes()


def _differ(whose: np.ndarray, of: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], odd: np.ndarray) -> np.ndarray:
    """Which programs that aren't odd, and so have as many rows in both tables, have other values in them."""
    mine, own = ~odd[whose], ~odd[of]
    found, other = np.zeros(len(odd), bool), np.zeros(int(own.sum()), bool)
    for a, b in pairs:
        other |= a[mine] != b[own]
    found[of[own][other]] = True
    return found


# ---- a generation --------------------------------------------------------------------------


def _bred(ops: np.ndarray, n: np.ndarray, palettes: tuple[np.ndarray, np.ndarray], size: tuple[int, int, int], config: SearchConfig, space: np.ndarray) -> tuple[np.ndarray, ...]:
    scenes, people = len(n), config.population
    every = np.arange(scenes)
    targets = Scenes(ops, n, palettes, size, space)
    words = 80 * people + 80
    made = np.zeros((2 * people - config.elites, *ops.shape), np.int16)
    count = np.zeros(made.shape[:2], np.int64)
    valid, length, units = np.zeros(count.shape, bool), np.zeros(count.shape, np.int64), np.zeros(count.shape, np.int64)
    texts: dict[int, tuple[np.ndarray, Callable]] = {}

    def evaluate(first: int, last: int) -> None:
        """Candidates first .. last - 1; one that an earlier one equals isn't new, so it is not valid here."""
        fresh = np.ones((last - first, scenes), bool)
        for k in range(first, last):
            for j in range(k):
                fresh[k - first] &= (count[k] != count[j]) | (made[k] != made[j]).any((1, 2))
        fresh &= ~targets.odd
        slot, scene = np.nonzero(fresh)
        slot += first
        if len(slot):
            valid[slot, scene], length[slot, scene], units[slot, scene], text = targets.evaluate(scene, made[slot, scene], count[slot, scene])
            at = np.full((last, scenes), -1)
            at[slot, scene] = np.arange(len(slot))
            texts.update({k: (at[k], text) for k in range(first, last)})

    def change(kinds: np.ndarray, child: _Ops, draws: Draws) -> _Ops:
        new, m = child[0].copy(), child[1].copy()
        for code in np.unique(kinds):
            who = np.flatnonzero(kinds == code)
            found = mutate(MUTATIONS[code], child[0][who], child[1][who], draws, who, palettes, size)
            if found is None:
                targets.odd[who] = True
            else:
                new[who], m[who] = found
        return new, m

    made[0], count[0] = ops, n
    for slot in range(1, people):
        kind = np.full(scenes, slot % len(MUTATIONS))
        made[slot], count[slot] = change(kind, (ops, n), Draws(config, 0, (1 << 32) + slot, scenes, words))
    evaluate(0, people)
    targets.odd |= ~valid[0]
    slots = np.where(valid[:people], np.arange(people)[:, None], 0).T
    rank = np.take_along_axis((length * (1 << 32) + units)[:people].T, slots, 1)
    order = np.argsort(rank, axis=1, kind="stable")
    slots, rank = np.take_along_axis(slots, order, 1), np.take_along_axis(rank, order, 1)
    tied = ((rank[:, 1:] == rank[:, :-1]) & (slots[:, 1:] != slots[:, :-1])).any(1) & ~targets.odd
    for s in np.flatnonzero(tied).tolist():
        read = lambda k, s=s: texts[k][1](texts[k][0][s])
        slots[s] = [k for *_, k in sorted((length[k, s], units[k, s], read(k), k) for k in slots[s].tolist())]

    draws = Draws(config, 0, 1, scenes, words)

    def parent(who: np.ndarray) -> np.ndarray:
        """The best of a tournament: people are in order, so the least place."""
        return slots[who, np.min([draws.below(who, people) for _ in range(config.tournament)], axis=0)]

    for child in range(people, len(made)):
        chosen = parent(every)
        new, m = made[chosen, every], count[chosen, every]
        crossed = np.flatnonzero(draws.u32(every) % np.uint64(100) < config.crossover_percent)
        if len(crossed):
            other = parent(crossed)
            both, several = _spliced((new[crossed], m[crossed]), (made[other, crossed], count[other, crossed]), draws, crossed)
            new[crossed], m[crossed] = both[:, : new.shape[1]], several
        kinds = (draws.u32(every) % np.uint64(len(MUTATIONS))).astype(np.int64)
        made[child], count[child] = _distinct(*change(kinds, (new, m), draws))
    evaluate(people, len(made))
    first = slots[:, 0]
    before, used = length[first, every], units[first, every]
    best = before * (1 << 32) + used
    ranks = np.where(valid[people:], length[people:] * (1 << 32) + units[people:], np.iinfo(np.int64).max)
    best = np.minimum(best, ranks.min(0))
    return before, best >> 32, best & (1 << 32) - 1, valid[people:].sum(0), valid[first, every], targets.odd


def generation(starts: np.ndarray, rows: np.ndarray, size: tuple[int, int, int], config: SearchConfig, scratch: dict) -> tuple[np.ndarray, ...]:
    """(bytes before, bytes, units, fresh, exact, odd) of scenes of boxes after a generation of the first island.

    rows: material, origin and size of each box, scene after scene; below zero where unknown.
    """
    scenes, n = len(starts) - 1, np.diff(starts)
    if config.islands != 1 or config.shard or config.survivors:
        raise ValueError("one island, and every offspring is evaluated")
    program = np.repeat(np.arange(scenes), n)
    bad = (rows < 0).any(1) | (rows > 120).any(1) | (rows[:, 0] < 1) | (rows[:, 4:] < 1).any(1)
    odd = n > _COMMANDS
    odd[program[bad]] = True
    odd |= np.bincount(program, np.clip(rows[:, 4:], 0, 128).prod(1), scenes) > _WRITES
    if max(size) > 120 or size[0] * size[1] * size[2] > 1 << 16:
        odd[:] = True
    found = [np.zeros(scenes, np.int64) for _ in range(4)] + [np.zeros(scenes, bool)]
    order = np.argsort(n, kind="stable")
    order = order[~odd[order]]
    if len(order) and "space" not in scratch:
        scratch["space"] = np.zeros(_RUN * size[0] * size[1] * size[2], np.uint8)
    for at in range(0, len(order), _SCENES):
        who = order[at : at + _SCENES]
        ops = np.zeros((len(who), 2 * int(n[who].max()) + 4, _WIDE), np.int16)
        of, i = _spread(n[who])
        ops[of, i, 0], ops[of, i, 1:8] = _OP["box"], rows[starts[who][of] + i]
        key = np.unique(of * 128 + rows[starts[who][of] + i, 0])
        several = np.bincount(key >> 7, minlength=len(who))
        palette = np.full((len(who), int(several.max())), 127, np.int64)
        palette[key >> 7, _spread(several)[1]] = key & 127
        *made, odd[who] = _bred(ops, n[who], (palette, several), size, config, scratch["space"])
        for all_, mine in zip(found, made):
            all_[who] = mine
    return *found, odd
