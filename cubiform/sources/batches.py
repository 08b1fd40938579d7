"""Many building programs at once, in numpy: bytes, cells and roots as programs.py has them one by one.

A program is odd if anything about it is unusual: an error, patches, long integers or masks, many writes, a
command that is not in MOVED or DRAWN. Odd ones are left to programs.py, so results and errors are its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import constants as K
from . import programs as P
from . import wire

#: Columns of the fields that are vectors.
_VECTORS = {"origin": ("ox", "oy", "oz"), "source": ("ox", "oy", "oz"), "size": ("sx", "sy", "sz"), "delta": ("dx", "dy", "dz"), "target": ("px", "py", "pz")}
_PLAIN = ("material", "axis", "length", "u", "v", "thickness", "depth", "width", "count", "height", "crown", "spacing", "turns")
_COLUMNS = ("op", "leaf", "style", "z_oriented", "mask", "mask_n", *_PLAIN, *dict.fromkeys(c for names in _VECTORS.values() for c in names))
_CODES = {name: i for i, name in enumerate(K.OPCODES)}
_GABLES = {f"gable_{style}_{o}": (i, int(o == "z")) for i, style in enumerate(K.GABLE_STYLES) for o in "xz"}
#: Commands without a material, and of those the ones that are run here; all other commands draw.
_BARE = [_CODES[k] for k in ("translate", "rotate_y", "mirror", "repeat_region", "clear_box")]
_MOVED = [_CODES[k] for k in ("translate", "rotate_y")]
_NONE = -(1 << 40)
_BITS = np.array([max(1, i.bit_length()) for i in range(1 << 10)])
_FIELDS = [[tuple(x.split(":")) for x in P.COMPACT[name].split()] for name in K.OPCODES]
_HEAD = K.COMPACT_MAGIC.encode() + bytes([1, K.PROFILES["building"], 0, 1])
#: Programs that are run at once, their cells together, and the writes of one.
_SCENES, _CELLS, _WRITES, _MASK = 512, 1 << 24, 1 << 14, 48


@dataclass
class Table:
    """Commands by column, program after program: those of program i are rows starts[i] to starts[i + 1]."""

    starts: np.ndarray
    sizes: np.ndarray
    cols: dict[str, np.ndarray]
    odd: np.ndarray

    def programs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.odd)), np.diff(self.starts))

    def part(self, first: int, last: int) -> Table:
        a, b = self.starts[first], self.starts[last]
        return Table(self.starts[first : last + 1] - a, self.sizes[first:last], {k: c[a:b] for k, c in self.cols.items()}, self.odd[first:last])

    def some(self, keep: np.ndarray) -> Table:
        rows, n = np.repeat(keep, np.diff(self.starts)), np.diff(self.starts)[keep]
        return Table(np.concatenate([[0], np.cumsum(n)]), self.sizes[keep], {k: c[rows] for k, c in self.cols.items()}, self.odd[keep])


def table(rows: pa.Table | pa.RecordBatch, starts: np.ndarray, size: tuple[int, int, int]) -> Table:
    """From rows of the command table, sorted by scene and order."""

    def numbers(name: str) -> np.ndarray:
        return pc.fill_null(rows.column(name), _NONE).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else pc.fill_null(rows.column(name), _NONE).to_numpy()

    cols = {c: numbers(c) for c in _COLUMNS if c in _PLAIN or c[-1] in "xyz" and len(c) == 2}
    names = pc.dictionary_encode(rows.column("op"))
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    kinds, at = names.dictionary.to_pylist(), pc.fill_null(names.indices, len(names.dictionary)).to_numpy(zero_copy_only=False)
    look = lambda f: np.array([*map(f, kinds), _NONE])[at]
    cols["op"] = look(lambda k: _CODES["gable"] if k in _GABLES else _CODES.get(k, _NONE))
    cols["style"], cols["z_oriented"] = (look(lambda k, j=j: _GABLES.get(k, (0, 0))[j]) for j in (0, 1))
    cols["leaf"] = numbers("material2")
    masks = rows.column("mask")
    masks = masks.combine_chunks() if isinstance(masks, pa.ChunkedArray) else masks
    n = pc.fill_null(pc.list_value_length(masks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bits = pc.fill_null(masks.flatten(), 2).to_numpy(zero_copy_only=False)
    row, left = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n) - np.arange(len(bits)) - 1
    short = n[row] <= _MASK
    cols["mask"], cols["mask_n"] = np.zeros(len(n), np.int64), np.where(n <= _MASK, n, _NONE)
    np.add.at(cols["mask"], row[short], bits[short] << left[short])
    cols["mask_n"][row[(bits < 0) | (bits > 1)]] = _NONE
    program, odd = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.zeros(len(starts) - 1, bool)
    odd[program[cols["op"] < 0]] = True
    cols["op"] = np.maximum(cols["op"], 0)
    return Table(starts, np.tile(np.array(size, np.int64), (len(odd), 1)), cols, odd)


def _along(kind: str, axis: np.ndarray | None, widths: np.ndarray) -> np.ndarray:
    """The bits of a length: those of the axis it lies on, see programs._length_axis."""
    if kind[1].isdigit():
        return widths[:, int(kind[1])]
    at = {"f": lambda a: np.where(a != 0, 2, 0), "a": lambda a: a, "u": lambda a: np.where(a == 0, 1, 0), "v": lambda a: np.where(a == 2, 1, 2)}[kind[1]](axis)
    return np.take_along_axis(widths, at[:, None], 1)[:, 0]


def encode(t: Table, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[pa.Array, np.ndarray]:
    """The compact bytes of each program, and which are odd and have none. more: (program, material) for the palettes."""
    n, program, op, odd = len(t.odd), t.programs(), t.cols["op"], t.odd.copy()
    widths = _BITS[np.clip(t.sizes - 1, 0, 511)]
    odd |= ((t.sizes < 1) | (t.sizes > 127)).any(1) | (np.diff(t.starts) > 127)
    # Copies have no material, but one that their row names is in the palette.
    painted, trees = np.flatnonzero(~np.isin(op, _BARE) | (t.cols["material"] != _NONE)), np.flatnonzero(op == _CODES["tree"])
    used = np.concatenate([t.cols["material"][painted], t.cols["leaf"][trees]])
    whose = program[np.concatenate([painted, trees])]
    if more:
        whose, used = np.concatenate([whose, more[0]]), np.concatenate([used, more[1]])
    odd[whose[(used < 1) | (used > 127)]] = True
    held = np.zeros(128 * n, bool)
    held[whose * 128 + np.clip(used, 0, 127)] = True
    key = np.flatnonzero(held)
    several = np.bincount(key >> 7, minlength=n)
    first = np.cumsum(several) - several
    odd |= (several == 0) | (several > 127)
    index = lambda rows, m: np.searchsorted(key, program[rows] * 128 + np.clip(m, 0, 127)) - first[program[rows]]
    m_bits = _BITS[np.clip(several - 1, 0, 127)]

    # The bits of each command, 128 at most, as two words.
    words, bits = np.zeros((len(op), 2), np.uint64), np.zeros(len(op), np.int64)
    for code in np.unique(op):
        rows = np.flatnonzero(op == code)
        own, of = widths[program[rows]], lambda c: t.cols[c][rows]  # noqa: B023, E731
        axis, wrong = of("axis"), np.zeros(len(rows), bool)
        high, low, long = np.zeros(len(rows), np.uint64), np.full(len(rows), code, np.uint64), np.full(len(rows), 4)
        if any(name == "axis" for name, _ in _FIELDS[code]):
            wrong |= (axis < 0) | (axis > 2)
            axis = np.clip(axis, 0, 2)
        for name, kind in _FIELDS[code]:
            for k, column in enumerate(_VECTORS.get(name, (name,))):
                v = of(column)
                if kind == "m":
                    v, b = index(rows, v), m_bits[program[rows]]
                elif kind in "os":
                    v, b = v - (kind == "s"), own[:, k]
                elif kind == "d":
                    wrong |= np.abs(v) > 256
                    v, b = np.where(v >= 0, 2 * v, -2 * v - 1), 10
                elif kind == "k":
                    b = np.maximum(of("mask_n"), 0)
                    wrong |= of("mask_n") < 0
                elif kind[0] == "l":
                    v, b = v - 1, _along(kind, axis, own)
                else:
                    width, _, less = kind[1:].partition("+")
                    if name == "count":
                        wrong |= v < 2
                    v, b = v - int(less or 0), int(width)
                bad = (v < 0) | (v >> b > 0)
                wrong |= bad
                v, width = np.where(bad, 0, v).astype(np.uint64), np.asarray(b, np.uint64)
                high, low, long = high << width | low >> np.uint64(64) - width, low << width | v, long + b
        odd[program[rows[wrong]]] = True
        left = (128 - long).astype(np.uint64)
        whole, rest = np.maximum(left, np.uint64(64)) - np.uint64(64), np.minimum(left, np.uint64(64))
        words[rows, 0] = np.where(left >= 64, low << whole, high << rest | low >> np.uint64(64) - rest)
        words[rows, 1], bits[rows] = low << left, long

    head, body = 13 + several, np.bincount(program, bits, n).astype(np.int64)
    ends = np.cumsum(head + -(-body // 8) + 1)
    at = ends - (head + -(-body // 8) + 1)
    out = np.zeros(ends[-1] if n else 0, np.uint8)
    for k, byte in enumerate(_HEAD):
        out[at + k] = byte
    for k in range(3):
        out[at + 8 + k] = t.sizes[:, k] & 127
    out[at + 11], out[at + 12 + several] = several & 127, np.diff(t.starts) & 127
    out[at[key >> 7] + 12 + np.arange(len(key)) - first[key >> 7]] = key & 127
    lit, edge = np.zeros(8 * len(out), np.uint8), np.zeros(8 * len(out) + 1, np.int8)
    some = body > 0
    edge[((at + head) * 8)[some]], edge[((at + head) * 8 + body)[some]] = 1, -1
    most = int(bits.max(initial=0))
    listed = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 16), axis=1, count=most)
    lit[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] = listed[np.arange(most) < bits[:, None]]
    out |= np.packbits(lit)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)]), odd


def _bytes(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and where each value begins, and the last ends, in them."""
    content = pc.fill_null(content, b"")
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    return np.frombuffer(content.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def decode(content: pa.Array) -> Table:
    """The programs of compact bytes."""
    t, length, _ = commands(content)
    data, offsets = _bytes(content)
    # Behind the commands: the tag of an empty residual as the last byte.
    end = offsets[:-1] + length
    t.odd |= (end + 1 != offsets[1:]) | (np.append(data, 0)[np.minimum(end, len(data))] != 0)
    return t


def commands(content: pa.Array) -> tuple[Table, np.ndarray, np.ndarray]:
    """The commands of compact bytes, how many bytes are in front of each residual, and the palettes."""
    n = len(content)
    data, offsets = _bytes(content)
    at, stop = offsets[:-1], offsets[1:]
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    last = len(data) - 9
    byte = lambda where: data[np.minimum(where, last)].astype(np.int64)
    odd = stop - at < 14
    for k, b in enumerate(_HEAD):
        odd |= byte(at + k) != b
    sizes = np.stack([byte(at + 8 + k) for k in range(3)], 1)
    several = byte(at + 11)
    odd |= ((sizes < 1) | (sizes > 127)).any(1) | (several < 1) | (several > 127)
    several = np.where(odd, 0, several)
    palette = np.zeros((n, int(several.max(initial=0)) + 1), np.int64)
    for k in range(palette.shape[1] - 1):
        palette[:, k] = np.where(k < several, byte(at + 12 + k), 0)
        odd |= (k < several) & ((palette[:, k] > 127) | (palette[:, k] <= (palette[:, k - 1] if k else 0)))
    count = byte(at + 12 + several)
    odd |= count > 127
    count = np.where(odd, 0, count)
    starts = np.concatenate([[0], np.cumsum(count)])
    window = np.zeros(last + 1, np.uint64)
    for k in range(8):
        window |= data[k : k + last + 1].astype(np.uint64) << np.uint64(56 - 8 * k)
    place = 8 * (at + 13 + several)
    widths, m_bits = _BITS[np.clip(sizes - 1, 0, 511)], _BITS[np.clip(several - 1, 0, 127)]
    cols = {c: np.full(starts[-1], _NONE if c == "material" else 0) for c in _COLUMNS}

    def read(who: np.ndarray, bits) -> np.ndarray:
        """The next bits of these programs, 48 at most; what lies behind the end shows in the place."""
        where, bits = place[who], np.asarray(bits, np.int64)
        place[who] += bits
        return ((window[np.minimum(where >> 3, last)] << (where & 7).astype(np.uint64)) >> (64 - bits).astype(np.uint64)).astype(np.int64)

    for step in range(int(count.max(initial=0))):
        going = np.flatnonzero((count > step) & ~odd)
        code = read(going, 4)
        odd[going[code >= len(K.OPCODES)]] = True
        for c in np.unique(code[code < len(K.OPCODES)]):
            who = going[code == c]
            rows, own, wrong = starts[who] + step, widths[who], np.zeros(len(who), bool)
            cols["op"][rows] = c
            for name, kind in _FIELDS[c]:
                for k, column in enumerate(_VECTORS.get(name, (name,))):
                    if kind == "m":
                        v = read(who, m_bits[who])
                        wrong |= v >= several[who]
                        v = palette[who, np.minimum(v, palette.shape[1] - 1)]
                    elif kind in "os":
                        v = read(who, own[:, k]) + (kind == "s")
                    elif kind == "d":
                        v = read(who, 10)
                        v = np.where(v % 2 == 0, v >> 1, -(v + 1 >> 1))
                        wrong |= np.abs(v) > 256
                    elif kind == "k":
                        area = cols["u"][rows] * cols["v"][rows]
                        wrong |= area > _MASK
                        cols["mask_n"][rows] = area = np.minimum(area, _MASK)
                        v = read(who, area)
                        wrong |= v == 0
                    elif kind[0] == "l":
                        v = read(who, _along(kind, np.minimum(cols["axis"][rows], 2), own)) + 1
                    else:
                        width, _, more = kind[1:].partition("+")
                        v = read(who, int(width)) + int(more or 0)
                        if name == "axis":
                            wrong |= v > 2
                    cols[column][rows] = v
            odd[who[wrong]] = True
    # Behind the commands: zeros up to a whole byte.
    spare = -place % 8
    odd |= read(np.arange(n), np.maximum(spare, 1)) >> np.where(spare, 0, 1) != 0
    end = place - np.where(spare, 0, 1) >> 3
    odd |= end >= stop
    return Table(starts, sizes, cols, odd), end - at, palette


def _boxes(t: Table) -> np.ndarray:
    """(row, material, x, y, z, w, h, d) of drawing commands' boxes, those of a command in order; see programs.op_boxes."""
    op, found, zero = t.cols["op"], [], np.int64(0)

    def of(rows: np.ndarray, *names: str) -> list[np.ndarray]:
        return [t.cols[c][rows] for c in names]

    def add(rows, m, x, y, z, w, h, d) -> None:
        found.append(np.stack(np.broadcast_arrays(rows, m, x, y, z, w, h, d)))

    def each(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(rows, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def placed(axis, along, u, v) -> list[np.ndarray]:
        return [np.where(axis == 0, along, u), np.where(axis == 1, along, np.where(axis == 0, u, v)), np.where(axis == 2, along, v)]

    def rows_of(name: str) -> np.ndarray:
        return np.flatnonzero(op == _CODES[name])

    if len(r := rows_of("box")):
        add(r, *of(r, "material", "ox", "oy", "oz", "sx", "sy", "sz"))
    if len(r := rows_of("run")):
        add(r, *of(r, "material", "ox", "oy", "oz"), *placed(*of(r, "axis", "length"), 1, 1))
    if len(r := rows_of("wall")):
        add(r, *of(r, "material", "ox", "oy", "oz"), *placed(*of(r, "axis", "thickness", "u", "v")))
    if len(r := rows_of("extrude")):
        r, i = each(r, t.cols["mask_n"][r])
        mask, n = of(r, "mask", "mask_n")
        lit = (mask >> n - 1 - i & 1) == 1
        r, i = r[lit], i[lit]
        m, x, y, z, axis, u, depth = of(r, "material", "ox", "oy", "oz", "axis", "u", "depth")
        add(r, m, *(o + a for o, a in zip((x, y, z), placed(axis, zero, i % u, i // u))), *placed(axis, depth, 1, 1))
    if len(r := rows_of("repeat_box")):
        r, i = each(r, t.cols["count"][r])
        add(r, *of(r, "material"), *(o + i * d for o, d in zip(of(r, "ox", "oy", "oz"), of(r, "dx", "dy", "dz"))), *of(r, "sx", "sy", "sz"))
    if len(r := rows_of("gable")):
        turned, width, depth = of(r, "z_oriented", "width", "depth")
        r, k = each(r, -(-np.where(turned == 1, depth, width) // 2))
        style, turned, width, depth = of(r, "style", "z_oriented", "width", "depth")
        span, across = np.where(turned == 1, depth, width), np.where(turned == 1, width, depth)
        for end in (0, 1):
            for side in (0, 1):
                # A fill has one piece, an outline one for each end, a trim one for each end and side.
                some = ((end == 0) | (style != 2) & (2 * k != span - 1)) & ((side == 0) | (style == 1))
                q, j, s, a, style_, turn = (c[some] for c in (r, k, span, across, style, turned))
                along, beside = np.where(end == 0, j, s - 1 - j), np.where(side == 0, 0, a - 1)
                long, broad = np.where(style_ == 2, s - 2 * j, 1), np.where(style_ == 1, 1, a)
                m, x, y, z = of(q, "material", "ox", "oy", "oz")
                add(q, m, x + np.where(turn == 1, beside, along), y + j, z + np.where(turn == 1, along, beside), np.where(turn == 1, broad, long), 1, np.where(turn == 1, long, broad))
    if len(r := rows_of("tree")):
        m, leaf, x, y, z, height, crown = of(r, "material", "leaf", "ox", "oy", "oz", "height", "crown")
        stem = np.maximum(height - crown, 2)
        add(r, m, x, y, z, 2, stem, 2)
        for k in range(int(crown.max())):
            q, leaf_, x_, y_, z_, crown_, stem_ = (c[crown > k] for c in (r, leaf, x, y, z, crown, stem))
            wide, up = np.maximum(crown_ - k // 2, 1), y_ + stem_ - 1 + k
            add(q, leaf_, x_ - wide, up, z_ - 1, 2 * wide + 2, 1, 4)
            add(q, leaf_, x_ - 1, up, z_ - wide, 4, 1, 2 * wide + 2)
        add(r, leaf, x, y + height - 1, z, 2, 1, 2)
    if len(r := rows_of("fence")):
        m, x, y, z, axis, length, spacing = of(r, "material", "ox", "oy", "oz", "axis", "length", "spacing")
        for up in (1, 3):
            add(r, m, x, y + up, z, np.where(axis == 0, length, 1), 1, np.where(axis == 0, 1, length))
        posts = -(-length // spacing)
        q, i = each(r, posts + 1)
        m, x, y, z, axis, length, spacing = of(q, "material", "ox", "oy", "oz", "axis", "length", "spacing")
        i = np.where(i == np.repeat(posts, posts + 1), length - 1, i * spacing)
        add(q, m, x + np.where(axis == 0, i, 0), y, z + np.where(axis == 0, 0, i), 1, 5, 1)
    return np.concatenate(found, 1) if found else np.zeros((8, 0), np.int64)


def _put(state: np.ndarray, keys: np.ndarray, first: int) -> None:
    """Numbers the writes of these cells from first on; of several to a cell the last stays."""
    numbers = np.arange(first, first + len(keys), dtype=np.int32)
    state[keys] = numbers
    if (state[keys] < numbers).any():  # numpy doesn't promise an order
        order = np.argsort(keys, kind="stable")
        last = order[np.append(keys[order][1:] != keys[order][:-1], True)]
        state[keys[last]] = numbers[last]


def _run(t: Table, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, material) of the cells that stay, and which programs are odd; a key is a program's cell in a scene of one size."""
    n, odd, program, size = len(t.odd), t.odd.copy(), t.programs(), t.sizes[int(np.argmin(t.odd))]
    volume, (sx, _, sz), op = int(size.prod()), map(int, size), t.cols["op"]
    odd |= (t.sizes != size).any(1)
    step, moved = np.arange(len(op)) - t.starts[program], np.isin(op, _MOVED)
    odd[program[np.isin(op, _BARE) & ~moved]] = True
    boxes = _boxes(t)
    row, low, extent = boxes[0], boxes[2:5].T, boxes[5:8].T
    odd[program[row[((extent < 1) | (low < 0) | (low + extent > size)).any(1)]]] = True
    boxes = boxes[:, ~odd[program[row]]]
    writes = np.bincount(program[boxes[0]], boxes[5:8].prod(0), n).astype(np.int64)
    odd |= writes > _WRITES
    boxes = boxes[:, ~odd[program[boxes[0]]]]
    boxes = boxes[:, np.lexsort((boxes[0], step[boxes[0]]))]
    row, (material, x, y, z, w, h, d) = boxes[0], boxes[1:].astype(np.int32)
    # Lines of cells along x, then cells: keys and numbers of writes fit into 32 bits.
    lines = h * d
    box = np.repeat(np.arange(len(lines)), lines)
    i = np.arange(len(box), dtype=np.int32) - np.repeat((np.cumsum(lines) - lines).astype(np.int32), lines)
    deep = d[box]
    up = i // deep
    begin = ((program[row] * volume).astype(np.int32) + x + sx * (z + sz * y))[box] + sx * (i + up * (sz - deep))
    wide = w[box]
    at = np.repeat(box, wide)
    drawn = np.repeat(begin - (np.cumsum(wide) - wide).astype(np.int32), wide) + np.arange(len(at), dtype=np.int32)
    painted, turn = material[at], np.searchsorted(step[row][at], np.arange(int(step.max(initial=-1)) + 2))
    keys, materials, done, total = [], [], 0, 0

    def write(new: np.ndarray, m: np.ndarray) -> None:
        nonlocal total
        _put(state, new, total)
        keys.append(new)
        materials.append(m)
        total += len(new)

    def alive() -> tuple[np.ndarray, np.ndarray]:
        key, m = np.concatenate([np.zeros(0, np.int32), *keys]), np.concatenate([np.zeros(0, np.int32), *materials])
        live = state[key] == np.arange(len(key), dtype=np.int32)
        return key[live], m[live]

    for k in np.unique(step[moved]):
        write(drawn[turn[done] : turn[k]], painted[turn[done] : turn[k]])
        done = k
        rows = np.flatnonzero(moved & (step == k))
        rows = rows[~odd[program[rows]]]
        start, span = (np.stack([t.cols[c][rows] for c in names], 1) for names in (_VECTORS["source"], _VECTORS["size"]))
        bad = ((span < 1) | (start < 0) | (start + span > size)).any(1) | (op[rows] == _CODES["rotate_y"]) & ((t.cols["turns"][rows] < 1) | (t.cols["turns"][rows] > 3))
        odd[program[rows[bad]]] = True
        of = np.full(n, -1)
        of[program[rows[~bad]]] = rows[~bad]
        key, m = alive()
        r = of[key // volume]
        key, m, r = key[r >= 0], m[r >= 0], r[r >= 0]
        cell = key - key // volume * volume
        line, level = cell // sx, cell // (sx * sz)
        a = [cell - line * sx, level, line - level * sz]
        o, e = ([t.cols[c][r] for c in names] for names in (_VECTORS["source"], _VECTORS["size"]))
        inside = np.logical_and.reduce([(p >= q) & (p < q + s) for p, q, s in zip(a, o, e)])
        key, m, r, a, o, e = key[inside], m[inside], r[inside], [c[inside] for c in a], [c[inside] for c in o], [c[inside] for c in e]
        count = np.bincount(key // volume, minlength=n)
        odd |= (of >= 0) & (count == 0)
        writes += count
        odd |= writes > _WRITES
        x, y, z = (p - q for p, q in zip(a, o))
        turns = t.cols["turns"][r]
        right, forth = np.choose(np.clip(turns, 1, 3) - 1, [e[2] - 1 - z, e[0] - 1 - x, z]), np.choose(np.clip(turns, 1, 3) - 1, [x, e[2] - 1 - z, e[0] - 1 - x])
        turned = op[r] == _CODES["rotate_y"]
        to = [np.where(turned, t.cols[p][r] + b, c + t.cols[q][r]) for p, q, b, c in zip(_VECTORS["target"], _VECTORS["delta"], (right, y, forth), a)]
        odd[key[np.logical_or.reduce([(c < 0) | (c >= s) for c, s in zip(to, size)])] // volume] = True
        keep = ~odd[key // volume]
        write((key // volume * volume + to[0] + sx * (to[2] + sz * to[1]))[keep].astype(np.int32), m[keep])
    write(drawn[turn[done] :], painted[turn[done] :])
    key, m = alive()
    for touched in keys:
        state[touched] = -1
    keep = ~odd[key // volume]
    key, m = key[keep], m[keep]
    order = np.argsort(key)
    return key[order], m[order], odd


def execute(t: Table, scratch: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(program, id, material) of the cells of all programs, by program and id, and which programs are odd and have none.

    scratch keeps the space for cells from call to call.
    """
    odd, found = t.odd.copy(), []
    even = np.flatnonzero(~odd)
    volume = int(t.sizes[even[0]].prod()) if len(even) else 1
    if volume > _CELLS:
        odd[:] = True
    many = max(1, min(_SCENES, _CELLS // volume))
    if scratch is None:
        scratch = {}
    if not odd.all() and len(scratch.get(volume, ())) < (need := min(many, len(odd)) * volume):
        scratch.clear()
        scratch[volume] = np.full(need, -1, np.int32)
    for first in range(0, len(odd), many):
        part = t.part(first, min(first + many, len(odd)))
        alike = ~part.odd & (part.sizes.prod(1) == volume)
        part.odd = odd[first : first + many] | ~alike
        if part.odd.all():
            odd[first : first + many] = True
            continue
        key, m, odd[first : first + many] = _run(part, scratch[volume])
        found.append((first + (key // volume).astype(np.int64), (key % volume).astype(np.int64), m.astype(np.int64)))
    return *(np.concatenate(c) for c in zip(*found or [(np.zeros(0, np.int64),) * 3])), odd


def roots(n: int, program: np.ndarray, ids: np.ndarray, materials: np.ndarray, size: tuple[int, int, int]) -> tuple[list[int], list[str]]:
    """How many cells each of n programs has, and its root; see programs.Scene."""
    counts = np.bincount(program, minlength=n)
    pairs = np.stack([ids - np.where(np.diff(program, prepend=-1) != 0, 0, np.concatenate([[0], ids[:-1] + 1])), materials], 1)
    values = pairs.ravel()
    lengths, long = np.ones(len(values), np.int64), np.flatnonzero(values >= 128)
    for k in range(1, 5):
        lengths[long] += values[long] >= 1 << 7 * k
    stops = np.cumsum(lengths)
    out, at = np.empty(stops[-1] if len(stops) else 0, np.uint8), stops - lengths
    out[at] = values & 127
    while len(long):
        out[at[long]] |= 128
        values[long] >>= 7
        at[long] += 1
        out[at[long]] = values[long] & 127
        long = long[values[long] >= 128]
    body = out.tobytes()
    ends = np.concatenate([[0], stops[1::2]])[np.cumsum(counts)].tolist()
    head = K.SEMANTIC_DOMAIN.encode() + bytes([0, K.PROFILES["building"]]) + b"".join(map(wire.varint, size))
    return counts.tolist(), [hashlib.sha256(head + wire.varint(c) + body[a:b]).hexdigest() for c, a, b in zip(counts.tolist(), [0, *ends[:-1]], ends)]


def rooted(content: pa.Array, scratch: dict) -> tuple[list, list, np.ndarray]:
    """Cells and root of what the commands of compact bytes draw, and which programs are odd and have neither."""
    t = decode(content)
    program, ids, materials, odd = execute(t, scratch)
    counts, made = [None] * len(odd), [None] * len(odd)
    for size in np.unique(t.sizes[~odd], axis=0):
        alike = np.flatnonzero(~odd & (t.sizes == size).all(1))
        at = np.full(len(odd), -1)
        at[alike] = np.arange(len(alike))
        mine = at[program] >= 0
        for i, n, root in zip(alike.tolist(), *roots(len(alike), at[program[mine]], ids[mine], materials[mine], size.tolist())):
            counts[i], made[i] = n, root
    return counts, made, odd
