"""Building programs: commands as plain dicts, their execution, and their wire formats.

The formats are tables: for every opcode, the fields in order with how each is written. One reader
and one writer serve them all. Field kinds: u8, v (integer), v- (integer, less one), s (odd values
negative), and vectors of three of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

from .. import constants as K
from . import wire
from .wire import BitReader, BitWriter, Bytes, FormatError, varint


@dataclass
class Program:
    size: tuple[int, int, int]
    ops: list[dict]
    palette: list[int] = field(default_factory=list)
    #: (id, kind, material), by id; kinds as in the difference operators.
    patches: list[tuple[int, int, int]] = field(default_factory=list)


@dataclass
class Scene:
    size: tuple[int, int, int]
    voxels: dict[int, int]
    writes: int = 0
    units: int = 0

    def canonical(self) -> bytes:
        ids = sorted(self.voxels)
        at = np.array(ids, np.int64)
        pairs = np.empty((len(ids), 2), np.int64)
        pairs[:, 0] = np.diff(at, prepend=-1) - 1
        pairs[:, 1] = [self.voxels[i] for i in ids]
        if (pairs < 0).any():
            raise FormatError("NonCanonical", "order")
        body = wire.varints(pairs.ravel())
        return b"".join(map(varint, self.size)) + varint(len(ids)) + body

    def root(self) -> str:
        return semantic_root("building", self.canonical())


def semantic_root(profile: str, canonical: bytes) -> str:
    return hashlib.sha256(K.SEMANTIC_DOMAIN.encode() + bytes([0, K.PROFILES[profile]]) + canonical).hexdigest()


def encoding_hash(profile: str, format_name: str, data: bytes) -> str:
    return hashlib.sha256(K.ENCODING_DOMAIN.encode() + bytes([0, K.PROFILES[profile], K.FORMATS[format_name]]) + data).hexdigest()


# ---- execution -----------------------------------------------------------------------------

TANGENTS = ((1, 2), (0, 2), (0, 1))


def _placed(origin, axis: int, along: int, u: int, v: int) -> tuple:
    out = [0, 0, 0]
    out[axis], (out[TANGENTS[axis][0]], out[TANGENTS[axis][1]]) = along, (u, v)
    return tuple(o + p for o, p in zip(origin, out))


def op_boxes(op: dict) -> list[tuple[int, tuple, tuple]]:
    """(material, origin, size) of a drawing command's boxes, in order."""
    kind, m, o = op["op"], op.get("material"), op.get("origin")
    zero = (0, 0, 0)
    if kind in ("box", "cut", "clear_box"):
        return [(m, o, op["size"])]
    if kind == "run":
        return [(m, o, _placed(zero, op["axis"], op["length"], 1, 1))]
    if kind == "wall":
        return [(m, o, _placed(zero, op["axis"], op["thickness"], op["u"], op["v"]))]
    if kind == "extrude":
        unit = _placed(zero, op["axis"], op["depth"], 1, 1)
        return [(m, _placed(o, op["axis"], 0, i % op["u"], i // op["u"]), unit) for i, bit in enumerate(op["mask"]) if bit]
    if kind == "repeat_box":
        return [(m, tuple(a + d * i for a, d in zip(o, op["delta"])), op["size"]) for i in range(op["count"])]
    x, y, z = o
    if kind == "gable":
        turned = op["z_oriented"]
        span, across = (op["depth"], op["width"]) if turned else (op["width"], op["depth"])
        found = []
        for k in range(-(-span // 2)):
            ends = sorted({k, span - 1 - k})
            if op["style"] == 2:
                pieces = [(k, 0, span - 2 * k, across)]
            elif op["style"] == 0:
                pieces = [(e, 0, 1, across) for e in ends]
            else:
                pieces = [(e, side, 1, 1) for e in ends for side in (0, across - 1)]
            for along, side, n_along, n_side in pieces:
                at, size = ((side, along), (n_side, n_along)) if turned else ((along, side), (n_along, n_side))
                found.append((m, (x + at[0], y + k, z + at[1]), (size[0], 1, size[1])))
        return found
    if kind == "tree":
        stem, leaf = max(op["height"] - op["crown"], 2), op["leaf"]
        found = [(m, o, (2, stem, 2))]
        for k in range(op["crown"]):
            r, up = max(op["crown"] - k // 2, 1), y + stem - 1 + k
            found += [(leaf, (x - r, up, z - 1), (2 * r + 2, 1, 4)), (leaf, (x - 1, up, z - r), (4, 1, 2 * r + 2))]
        return [*found, (leaf, (x, y + op["height"] - 1, z), (2, 1, 2))]
    if kind == "fence":
        along = lambda i: (x + i, y, z) if op["axis"] == 0 else (x, y, z + i)
        rail = (op["length"], 1, 1) if op["axis"] == 0 else (1, 1, op["length"])
        posts = [*range(0, op["length"], op["spacing"]), op["length"] - 1]
        return [(m, (x, y + 1, z), rail), (m, (x, y + 3, z), rail), *((m, along(i), (1, 5, 1)) for i in posts)]
    raise FormatError("UnknownOpcode", str(kind))


def ids_in(size, origin, extent) -> list[int]:
    """Cells of a box that must be inside the scene."""
    if any(e < 1 or o < 0 or o + e > s for o, e, s in zip(origin, extent, size)):
        raise FormatError("OutOfBounds", "box")
    (x, y, z), (w, h, d), (sx, _, sz) = origin, extent, size
    return [i for yy in range(y, y + h) for zz in range(z, z + d) for i in range(x + sx * (zz + sz * yy), x + w + sx * (zz + sz * yy))]


def _volume(extent) -> int:
    return extent[0] * extent[1] * extent[2]


def _copies(op: dict, scene: Scene) -> list[tuple[int, int]]:
    """(id, material) that a transform writes: a snapshot of its source, moved."""
    size = scene.size
    source, extent = op["source"], op["size"]
    if any(e < 1 or o < 0 or o + e > s for o, e, s in zip(source, extent, size)):
        raise FormatError("OutOfBounds", "region")
    sx, _, sz = size
    ids = np.fromiter(scene.voxels, np.int64, len(scene.voxels))
    at = (ids % sx, ids // (sx * sz), ids // sx % sz)
    inside = np.ones(len(ids), bool)
    for a, s, e in zip(at, source, extent):
        inside &= (a >= s) & (a < s + e)
    ids = np.sort(ids[inside])
    if not len(ids):
        raise FormatError("NonCanonical", "empty-region")
    at = (ids % sx, ids // (sx * sz), ids // sx % sz)
    r = [a - s for a, s in zip(at, source)]
    held = [scene.voxels[i] for i in ids.tolist()]
    found = []
    for copy in range(1, op["count"]) if op["op"] == "repeat_region" else (1,):
        if op["op"] in ("translate", "repeat_region"):
            to = [a + d * copy for a, d in zip(at, op["delta"])]
        elif op["op"] == "rotate_y":
            turn = {1: (extent[2] - 1 - r[2], r[0]), 2: (extent[0] - 1 - r[0], extent[2] - 1 - r[2]), 3: (r[2], extent[0] - 1 - r[0])}[op["turns"]]
            to = [op["target"][0] + turn[0], op["target"][1] + r[1], op["target"][2] + turn[1]]
        elif "pivot_twice" in op:
            to = [op["pivot_twice"] - a if k == op["axis"] else a for k, a in enumerate(at)]
        else:
            to = [t + (e - 1 - v if k == op["axis"] else v) for k, (t, e, v) in enumerate(zip(op["target"], extent, r))]
        if any(a.min() < 0 or a.max() >= s for a, s in zip(to, size)):
            raise FormatError("OutOfBounds", "copy")
        found += zip((to[0] + sx * (to[2] + sz * to[1])).tolist(), held)
    return found


def execute(program: Program, limits: dict | None = None) -> Scene:
    """Runs a program; every write is charged, whether or not it changes anything."""
    most = {k: v[0] for k, v in K.LIMITS.items()} | (limits or {})
    scene = Scene(tuple(program.size), {})
    if len(program.ops) > most["max_commands"]:
        raise FormatError("ResourceLimit", "commands")
    for op in program.ops:
        if op["op"] in ("translate", "rotate_y", "mirror", "repeat_region"):
            made = _copies(op, scene)
            charge = len(made)
            scene.voxels.update(made)
        elif op["op"] in ("cut", "clear_box"):
            cells = ids_in(scene.size, op["origin"], op["size"])
            gone = [i for i in cells if i in scene.voxels]
            if op["op"] == "clear_box" and not gone:
                raise FormatError("NonCanonical", "empty-clear")
            charge = len(gone) if op["op"] == "clear_box" else len(cells)
            for i in gone:
                del scene.voxels[i]
        else:
            boxes = op_boxes(op)
            charge = sum(_volume(b[2]) for b in boxes)
            if charge > most["max_op_expansion"]:
                raise FormatError("ResourceLimit", "expansion")
            for m, at, extent in boxes:
                scene.voxels.update(dict.fromkeys(ids_in(scene.size, at, extent), m))
        scene.writes += charge
        scene.units += charge + 1
        if charge > most["max_op_expansion"] or scene.writes > most["max_writes"]:
            raise FormatError("ResourceLimit", "writes")
        if len(scene.voxels) > most["max_voxels"]:
            raise FormatError("ResourceLimit", "voxels")
    apply_patches(scene, program.patches)
    scene.writes += len(program.patches)
    scene.units += 2 * len(program.patches)
    if scene.units > most["max_decode_units"]:
        raise FormatError("ResourceLimit", "decode-units")
    return scene


def apply_patches(scene: Scene, patches: list[tuple[int, int, int]]) -> None:
    """0 sets an empty cell, 1 clears a full one, 2 paints another material; nothing may be in vain."""
    for i, kind, m in patches:
        have = scene.voxels.get(i)
        if (kind == 0) != (have is None) or (kind == 2 and have == m):
            raise FormatError("NonCanonical", "patch")
        if kind == 1:
            del scene.voxels[i]
        else:
            scene.voxels[i] = m


def difference(target: dict[int, int], have: dict[int, int]) -> list[tuple[int, int, int]]:
    """The patches that turn have into target."""
    found = []
    for i in sorted(target.keys() | have.keys()):
        a, b = target.get(i), have.get(i)
        if a != b:
            found.append((i, 0 if b is None else 1 if a is None else 2, a or 0))
    return found


# ---- the legacy format ---------------------------------------------------------------------

_GABLES = {3: (0, 0), 6: (1, 0), 7: (2, 0), 8: (0, 1), 9: (1, 1), 10: (2, 1)}
LEGACY = {
    1: ("box", "material:v origin:vvv size:---"), 2: ("repeat_box", "material:v origin:vvv size:--- count:- delta:sss"),
    4: ("tree", "material:v leaf:v origin:vvv height:v crown:v"), 5: ("fence", "material:v origin:vvv length:- axis:v spacing:v"),
} | {code: ("gable", "material:v origin:vvv width:- depth:-") for code in _GABLES}


def _read_fields(r: Bytes, spec: str) -> dict:
    found = {}
    for part in spec.split():
        name, kinds = part.split(":")
        values = []
        for k in kinds:
            v = r.byte() if k == "b" else r.varint()
            values.append(v + 1 if k == "-" else -(v + 1 >> 1) if k == "s" and v % 2 else v >> 1 if k == "s" else wire.unzigzag(v) if k == "z" else v)
        found[name] = values[0] if len(values) == 1 else tuple(values)
    return found


def _write_fields(op: dict, spec: str) -> bytes:
    out = b""
    for part in spec.split():
        name, kinds = part.split(":")
        values = op[name] if len(kinds) > 1 else (op[name],)
        for k, v in zip(kinds, values):
            out += bytes([v]) if k == "b" else varint(v - 1 if k == "-" else wire.zigzag(v) if k in "sz" else v)
    return out


def read_legacy(data: bytes) -> Program:
    """Version 1. Limits are checked as they are met; geometry is checked when it is run."""
    if not data or len(data) > 65_535:
        raise FormatError("ResourceLimit", "payload")
    r = Bytes(data)
    if r.byte() != 1:
        raise FormatError("UnsupportedVersion", "legacy-version")
    size = tuple(r.varint() for _ in range(3))
    if any(not 1 <= s <= 256 for s in size):
        raise FormatError("OutOfBounds", "dimensions")
    count = r.varint()
    if count > 4096:
        raise FormatError("ResourceLimit", "commands")
    ops, budget = [], 0
    for _ in range(count):
        code = r.byte()
        if code not in LEGACY:
            raise FormatError("UnknownOpcode", "legacy-opcode")
        name, spec = LEGACY[code]
        op = {"op": name, **_read_fields(r, spec)}
        if any(not 1 <= op[m] <= 0xFFFF for m in ("material", "leaf") if m in op):
            raise FormatError("OutOfBounds", "material")
        if name == "gable":
            op["style"], op["z_oriented"] = _GABLES[code]
        if name == "repeat_box" and (op["count"] > 512 or any(abs(d) > 256 for d in op["delta"])):
            raise FormatError("OutOfBounds", "repeat")
        if name == "tree" and not (2 <= op["height"] <= 64 and 1 <= op["crown"] <= 16):
            raise FormatError("OutOfBounds", "tree")
        if name == "fence" and not (op["length"] <= 256 and op["axis"] <= 1 and 1 <= op["spacing"] <= 64):
            raise FormatError("OutOfBounds", "fence")
        if name in ("box", "repeat_box"):
            budget += _volume(op["size"]) * op.get("count", 1)
            if budget > 262_144:
                raise FormatError("ResourceLimit", "operations")
        ops.append(op)
    r.end()
    return Program(size, ops, sorted({op[m] for op in ops for m in ("material", "leaf") if m in op}))


def write_legacy(program: Program) -> bytes:
    """Version 1, for programs of the commands it has."""
    turned = {v: k for k, v in _GABLES.items()}
    codes = {name: code for code, (name, _) in LEGACY.items()}
    out = b"\1" + b"".join(map(varint, (*program.size, len(program.ops))))
    for op in program.ops:
        code = turned[op["style"], int(op["z_oriented"])] if op["op"] == "gable" else codes[op["op"]]
        out += bytes([code]) + _write_fields(op, LEGACY[code][1])
    return out


# ---- the compact format --------------------------------------------------------------------

#: Fields: m palette index, o origin, s size less one, l<axis> a length less one, n<bits> a number, d a delta.
COMPACT = {
    "box": "material:m origin:o size:s", "repeat_box": "material:m origin:o size:s count:n9+1 delta:d", "gable": "material:m style:n2 z_oriented:n1 origin:o width:l0 depth:l2",
    "tree": "material:m leaf:m origin:o height:n6+2 crown:n4+1", "fence": "material:m origin:o axis:n1 length:lf spacing:n6+1", "run": "material:m origin:o axis:n2 length:la",
    "wall": "material:m origin:o axis:n2 u:lu v:lv thickness:la", "extrude": "material:m origin:o axis:n2 u:lu v:lv depth:la mask:k", "translate": "source:o size:s delta:d",
    "rotate_y": "source:o size:s target:o turns:n2", "mirror": "source:o size:s target:o axis:n2", "repeat_region": "source:o size:s count:n9+1 delta:d", "clear_box": "origin:o size:s",
}


def bits_of(v: int) -> int:
    return max(1, v.bit_length())


def _length_axis(kind: str, op: dict) -> int:
    which = kind[1]
    if which.isdigit():
        return int(which)
    if op["axis"] > 2:
        raise FormatError("OutOfBounds", "axis")
    return {"f": 2 if op["axis"] else 0, "a": op["axis"], "u": TANGENTS[op["axis"]][0], "v": TANGENTS[op["axis"]][1]}[which]


_SPECS = {spec: [part.split(":") for part in spec.split()] for spec in COMPACT.values()}


def _each_field(spec: str) -> list[list[str]]:
    return _SPECS[spec]


def write_compact(program: Program) -> bytes:
    """Header, palette and commands; see encode() for the whole."""
    palette = program.palette
    if not palette or any(b <= a for a, b in zip([0, *palette], palette)):
        raise FormatError("NonCanonical", "palette")
    at = {m: i for i, m in enumerate(palette)}
    c, m_bits = [bits_of(s - 1) for s in program.size], bits_of(len(palette) - 1)
    w = BitWriter()
    for op in program.ops:
        w.write(K.OPCODES.index(op["op"]), 4)
        for name, kind in _each_field(COMPACT[op["op"]]):
            v = op[name]
            if kind == "m":
                w.write(at[v], m_bits)
            elif kind in "os":
                for x, n in zip(v, c):
                    w.write(x - (kind == "s"), n)
            elif kind == "d":
                for x in v:
                    if abs(x) > 256:
                        raise FormatError("OutOfBounds", "delta")
                    w.write(wire.zigzag(x), 10)
            elif kind == "k":
                for bit in v:
                    w.write(bit, 1)
            elif kind[0] == "l":
                w.write(v - 1, c[_length_axis(kind, op)])
            else:
                n, _, less = kind[1:].partition("+")
                if name == "count" and v < 2:
                    raise FormatError("OutOfBounds", "count")
                w.write(v - int(less or 0), int(n))
    head = b"".join(map(varint, (*program.size, len(palette), *palette, len(program.ops))))
    return K.COMPACT_MAGIC.encode() + bytes([1, K.PROFILES["building"], 0, 1]) + head + w.bytes()


def _read_op(bits: BitReader, palette: list[int], c: list[int], m_bits: int) -> dict:
    code = bits.read(4)
    if code >= len(K.OPCODES):
        raise FormatError("UnknownOpcode", "compact")
    op: dict = {"op": K.OPCODES[code]}
    for name, kind in _each_field(COMPACT[op["op"]]):
        if kind == "m":
            i = bits.read(m_bits)
            if i >= len(palette):
                raise FormatError("OutOfBounds", "palette-index")
            op[name] = palette[i]
        elif kind in "os":
            op[name] = tuple(bits.read(n) + (kind == "s") for n in c)
        elif kind == "d":
            op[name] = tuple(wire.unzigzag(bits.read(10)) for _ in range(3))
            if any(abs(x) > 256 for x in op[name]):
                raise FormatError("OutOfBounds", "delta")
        elif kind == "k":
            op[name] = [bits.read(1) for _ in range(op["u"] * op["v"])]
            if not any(op[name]):
                raise FormatError("NonCanonical", "mask")
        elif kind[0] == "l":
            op[name] = bits.read(c[_length_axis(kind, op)]) + 1
        else:
            n, _, more = kind[1:].partition("+")
            op[name] = bits.read(int(n)) + int(more or 0)
    return op


def _action(kind: int, m: int, at: dict[int, int]) -> bytes:
    return bytes([kind]) + (b"" if kind == 1 else varint(at[m]))


def _stretches(patches: list, row: int | None = None) -> list[tuple[int, int, int, int]]:
    """(start, length, kind, material) of neighbours alike; with row, none leaves its row."""
    out: list[list[int]] = []
    for i, kind, m in patches:
        last = out[-1] if out else None
        if last and last[0] + last[1] == i and (last[2], last[3]) == (kind, m) and not (row and i % row == 0):
            last[1] += 1
        else:
            out.append([i, 1, kind, m])
    return [tuple(o) for o in out]


def residuals(size, palette: list[int], patches: list[tuple[int, int, int]]) -> list[bytes]:
    """The patches in each of the codecs that can hold them, tag first."""
    if not patches:
        return [b"\0"]
    at = {m: i for i, m in enumerate(palette)}
    sx, sy, sz = size
    ids = [p[0] for p in patches]
    runs = _stretches(patches)
    ends = [0, *(s + n for s, n, *_ in runs)]
    boxes = _stretches(patches, sx)
    layers: dict[tuple, list[int]] = {}
    groups: dict[tuple, list[int]] = {}
    for i, kind, m in patches:
        layers.setdefault((i // (sx * sz), kind, m), []).append(i % (sx * sz))
        groups.setdefault((kind, m), []).append(i)

    def bitmap(places: list[int], n: int) -> bytes:
        return sum(1 << n - 1 - p for p in places).to_bytes(n // 8, "big")

    whole = lambda n: -(-n // 8) * 8
    return [
        b"\1" + varint(len(patches)) + b"".join(varint(g) + _action(k, m, at) for g, (_, k, m) in zip(wire.gaps(ids), patches)),
        b"\2" + varint(len(runs)) + b"".join(varint(s - e) + varint(n - 1) + _action(k, m, at) for e, (s, n, k, m) in zip(ends, runs)),
        b"\3" + varint(len(boxes)) + b"".join(b"".join(map(varint, (s % sx, s // (sx * sz), s // sx % sz, n - 1, 0, 0))) + _action(k, m, at) for s, n, k, m in boxes),
        b"\4" + varint(len(layers)) + b"".join(varint(y) + _action(k, m, at) + bitmap(p, whole(sx * sz)) for (y, k, m), p in sorted(layers.items())),
        b"\5" + bitmap(ids, whole(sx * sy * sz)) + b"".join(_action(k, m, at) for _, k, m in patches),
        b"\6" + varint(len(groups)) + b"".join(_action(k, m, at) + varint(len(g)) + b"".join(map(varint, wire.gaps(g))) for (k, m), g in sorted(groups.items())),
    ]


def read_residual(r: Bytes, size, palette: list[int]) -> list[tuple[int, int, int]]:
    """Patches in order of ids, whichever codec holds them."""
    sx, sy, sz = size
    volume = sx * sy * sz
    most = K.LIMITS["max_patches"][0]

    def action() -> tuple[int, int]:
        kind = r.byte()
        if kind > 2:
            raise FormatError("UnknownOpcode", "patch")
        i = r.varint() if kind != 1 else None
        if i is not None and i >= len(palette):
            raise FormatError("OutOfBounds", "palette-index")
        return kind, 0 if i is None else palette[i]

    def rising(keys: list) -> None:
        if any(b <= a for a, b in zip(keys, keys[1:])):
            raise FormatError("NonCanonical", "order")

    def set_bits(n: int) -> list[int]:
        return [i for i, bit in enumerate(wire.read_mask(r, n)) if bit]

    tag, found = r.byte(), []
    if tag == 0:
        return []
    if tag > 6:
        raise FormatError("UnknownOpcode", "residual")
    if tag == 5:
        found = [(i, *action()) for i in set_bits(volume)]
    else:
        count = r.varint()
        if not 0 < count <= most:
            raise FormatError("NonCanonical" if not count else "ResourceLimit", "residual-count")
        keys, at = [], 0
        for n in range(count):
            if tag == 1:
                at += r.varint() + (n > 0)
                found.append((at, *action()))
            elif tag == 2:
                at += r.varint()
                length = r.varint() + 1
                kind, m = action()
                spread, at = range(at, at + length), at + length
            elif tag == 3:
                origin, extent = tuple(r.varint() for _ in range(3)), tuple(r.varint() + 1 for _ in range(3))
                if any(o + e > s for o, e, s in zip(origin, extent, size)):
                    raise FormatError("OutOfBounds", "residual-box")
                if _volume(extent) > most:
                    raise FormatError("ResourceLimit", "residual-box")
                kind, m = action()
                spread = ids_in(size, origin, extent)
                keys.append(spread[0])
            elif tag == 4:
                y = r.varint()
                kind, m = action()
                if y >= sy:
                    raise FormatError("OutOfBounds", "layer")
                spread = [y * sx * sz + p for p in set_bits(sx * sz)]
                keys.append((y, kind, m))
            else:
                kind, m = action()
                spread = wire.read_gaps(r, r.varint())
                keys.append((kind, m))
            if tag > 1:
                if len(spread) + len(found) > most or not len(spread):
                    raise FormatError("ResourceLimit" if len(spread) else "NonCanonical", "residual-size")
                found += [(i, kind, m) for i in spread]
        rising(keys)
    found.sort()
    rising([i for i, *_ in found])
    if not found or found[-1][0] >= volume:
        raise FormatError("OutOfBounds" if found else "NonCanonical", "residual")
    return found


def encode(program: Program) -> bytes:
    """The compact form with the smallest residual, ties to the lesser tag."""
    return write_compact(program) + min(residuals(program.size, program.palette, program.patches), key=lambda b: (len(b), b[0]))


def decode(data: bytes) -> Program:
    r = Bytes(data)
    if r.take(4) != K.COMPACT_MAGIC.encode():
        raise FormatError("InvalidEncoding", "magic")
    version, profile, flags, codec = r.take(4)
    if version != 1 or flags or codec != 1 or profile != K.PROFILES["building"]:
        raise FormatError("UnsupportedVersion", "header")
    size = tuple(r.varint() for _ in range(3))
    if any(not 1 <= s <= 512 for s in size):
        raise FormatError("OutOfBounds", "dimensions")
    n = r.varint()
    if not 1 <= n <= K.LIMITS["max_materials"][0]:
        raise FormatError("NonCanonical", "palette")
    palette = [r.varint() for _ in range(n)]
    if any(b <= a for a, b in zip([0, *palette], palette)) or palette[-1] > 0xFFFF:
        raise FormatError("NonCanonical", "palette")
    count = r.varint()
    if count > K.LIMITS["max_commands"][0]:
        raise FormatError("ResourceLimit", "commands")
    bits = BitReader(data, r.at)
    c, m_bits = [bits_of(s - 1) for s in size], bits_of(n - 1)
    ops = [_read_op(bits, palette, c, m_bits) for _ in range(count)]
    r.at = bits.align()
    patches = read_residual(r, size, palette)
    r.end()
    return Program(size, ops, palette, patches)


def exactify(program: Program, target: Scene) -> Program:
    """The program with the patches that make it draw the target, and a palette that has them."""
    base = execute(Program(program.size, program.ops))
    patches = difference(target.voxels, base.voxels)
    used = {m for _, kind, m in patches if kind != 1} | {op[m] for op in program.ops for m in ("material", "leaf") if m in op}
    return Program(program.size, program.ops, sorted(used | set(program.palette)) or [1], patches)


def wrap(profile: str, format_name: str, payload: bytes) -> bytes:
    """A source as it is, inside the compact envelope."""
    return K.COMPACT_MAGIC.encode() + bytes([1, K.PROFILES[profile], 0, 0, K.FORMATS[format_name]]) + varint(len(payload)) + payload


def unwrap(data: bytes) -> tuple[str, bytes]:
    r = Bytes(data, 8)
    code = r.byte()
    names = {v: k for k, v in K.FORMATS.items()}
    if code not in names:
        raise FormatError("InvalidEncoding", "wrapped-format")
    payload = r.block()
    r.end()
    return names[code], payload


def audit(source: bytes) -> dict:
    """What the compact form saves on a legacy building, and which of the two is chosen."""
    scene = execute(read_legacy(source))
    wrapped = wrap("building", K.LEGACY, source)
    try:
        compact = encode(read_legacy(source))
        if execute(decode(compact)).voxels != scene.voxels:
            raise FormatError("SemanticMismatch", "transcode")
    except FormatError:  # what the compact form can't say goes wrapped
        compact = wrapped
    best = min((compact, wrapped), key=lambda b: (len(b), b))
    saved = len(source) - len(best)
    return {
        "source_bytes": len(source), "compact_bytes": len(best), "wrapped_bytes": len(wrapped), "saved_bytes": saved, "saved_bps": int(saved * 10000 / len(source)),
        "root": scene.root(), "voxels": len(scene.voxels), "units": execute(decode(compact)).units if best is compact and compact is not wrapped else scene.units,
        "selected": "compact" if len(best) < len(source) else "source", "deep_search": len(best) <= len(source) + 16, "encoding": best,
    }
