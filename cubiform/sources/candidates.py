"""Candidate programs of the first machine, for terrain, buildings and forged items.

A program is a list of commands and patches; stored bytes and decode units are what candidates
compete on. Units of a command are a base and one for each write.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .. import constants as K
from . import programs as P
from . import wire
from .forged import CELLS, Component, Forged, appearance_bytes, cell_id, component_head, extruded, paint_bytes, tangent_area
from .wire import Bytes, FormatError, varint

UNIVERSE = K.TERRAIN_GRID[0] * K.TERRAIN_GRID[1] * K.TERRAIN_GRID[2]

#: Opcode, field layout and base units of building commands.
BUILDING = {
    "box": (1, "material:v origin:vvv size:vvv", 8), "run": (2, "material:v origin:vvv axis:b length:v", 5), "wall": (3, "material:v origin:vvv axis:b u:v v:v thickness:v", 7),
    "extrude": (4, "material:v origin:vvv axis:b u:v v:v depth:v", 12), "repeat_box": (5, "material:v origin:vvv size:vvv count:v delta:zzz", 12),
    "mirror": (6, "source:vvv size:vvv axis:b pivot_twice:z", 16), "cut": (7, "origin:vvv size:vvv", 8), "literal": (8, "", 8),
}


@dataclass
class TerrainProgram:
    min_y: int
    ops: list[dict]
    #: (id, 0 add or 1 restore).
    patches: list[tuple[int, int]] = field(default_factory=list)


def head(profile: str) -> bytes:
    return K.MACHINE_MAGIC.encode() + bytes([1, K.PROFILES[profile], 1, 0])


def _check_head(r: Bytes, profile: str) -> None:
    if r.take(4) != K.MACHINE_MAGIC.encode():
        raise FormatError("InvalidEncoding", "magic")
    version, found, cost, flags = r.take(4)
    if version != 1 or cost != 1 or flags:
        raise FormatError("UnsupportedVersion", "header")
    if found != K.PROFILES[profile]:
        raise FormatError("ProfileMismatch", "profile")


def _patches(patches: list[tuple]) -> bytes:
    """(id, kind, [material]) with kinds from 0x80."""
    found = [varint(len(patches))]
    for g, (_, kind, *m) in zip(wire.gaps([p[0] for p in patches]), patches):
        found += (bytes([0x80 + kind]), varint(g), *map(varint, m))
    return b"".join(found)


def _read_patches(r: Bytes, kinds: int, material: bool) -> list[tuple]:
    found, at = [], -1
    for _ in range(r.varint()):
        kind = r.byte() - 0x80
        if not 0 <= kind < kinds:
            raise FormatError("UnknownOpcode", "patch")
        at += r.varint() + 1
        found.append((at, kind, r.varint()) if material else (at, kind))
    return found


# ---- buildings -----------------------------------------------------------------------------


def write_building(program: P.Program) -> bytes:
    out = head("building") + b"".join(map(varint, (*program.size, len(program.ops))))
    for op in program.ops:
        code, spec, _ = BUILDING[op["op"]]
        out += bytes([code]) + P._write_fields(op, spec)
        if op["op"] == "extrude":
            out += wire.pack_mask(op["mask"])
        if op["op"] == "literal":
            ids = sorted(op["voxels"])
            out += varint(len(ids)) + b"".join(varint(g) + varint(op["voxels"][i]) for i, g in zip(ids, wire.gaps(ids)))
    return out + _patches([(i, k, m) for i, k, m in program.patches])


def read_building(data: bytes) -> P.Program:
    r = Bytes(data)
    _check_head(r, "building")
    size = tuple(r.varint() for _ in range(3))
    if any(not 1 <= s <= 512 for s in size):
        raise FormatError("OutOfBounds", "dimensions")
    codes = {code: (name, spec) for name, (code, spec, _) in BUILDING.items()}
    ops = []
    count = r.varint()
    if count > K.LIMITS["max_commands"][0]:
        raise FormatError("ResourceLimit", "commands")
    for _ in range(count):
        code = r.byte()
        if code not in codes:
            raise FormatError("UnknownOpcode", "building-opcode")
        name, spec = codes[code]
        op = {"op": name, **P._read_fields(r, spec)}
        if op.get("axis", 0) > 2:
            raise FormatError("OutOfBounds", "axis")
        if name == "extrude":
            op["mask"] = wire.read_mask(r, op["u"] * op["v"])
        if name == "literal":
            at, voxels = -1, {}
            for _ in range(r.varint()):
                at += r.varint() + 1
                voxels[at] = r.varint()
            op["voxels"] = voxels
        ops.append(op)
    patches = _read_patches(r, 3, True)
    r.end()
    return P.Program(size, ops, [], patches)


def run_building(program: P.Program, limits: dict | None = None) -> P.Scene:
    """Executes with this machine's charges: base units and writes; a mirror's copies count twice."""
    most = {k: v[0] for k, v in K.LIMITS.items()} | (limits or {})
    scene = P.Scene(tuple(program.size), {})
    for op in program.ops:
        base = BUILDING[op["op"]][2]
        if op["op"] == "literal":
            writes = len(op["voxels"])
            scene.voxels.update(op["voxels"])
        else:
            writes = _step(scene, op, most)
        base += {"extrude": len(op.get("mask", ())), "repeat_box": op.get("count", 0), "literal": writes, "mirror": writes}.get(op["op"], 0)
        scene.writes += writes
        scene.units += base + writes
        if writes > most["max_op_expansion"] or scene.writes > most["max_writes"]:
            raise FormatError("ResourceLimit", "writes")
        if len(scene.voxels) > most["max_voxels"]:
            raise FormatError("ResourceLimit", "voxels")
    P.apply_patches(scene, program.patches)
    scene.writes += len(program.patches)
    scene.units += 6 * len(program.patches)
    return scene


def _step(scene: P.Scene, op: dict, most: dict) -> int:
    if op["op"] == "mirror":
        made = P._copies(op, scene)
        scene.voxels.update(made)
        return len(made)
    if op["op"] == "cut":
        cells = P.ids_in(scene.size, op["origin"], op["size"])
        for i in cells:
            scene.voxels.pop(i, None)
        return len(cells)
    boxes = P.op_boxes(op)
    writes = sum(P._volume(b[2]) for b in boxes)
    if writes > most["max_op_expansion"]:
        raise FormatError("ResourceLimit", "expansion")
    for m, at, extent in boxes:
        scene.voxels.update(dict.fromkeys(P.ids_in(scene.size, at, extent), m))
    return writes


# ---- terrain -------------------------------------------------------------------------------


def low_bits(n: int) -> int:
    """floor(log2(universe / n)) of the split into low and high parts."""
    return max(0, (UNIVERSE // n).bit_length() - 1)


def write_elias_fano(values: list[int]) -> bytes:
    n, low = len(values), low_bits(len(values))
    lows = wire.BitWriter()
    for v in values:
        lows.write(v & (1 << low) - 1, low)
    highs = [0] * ((UNIVERSE - 1 >> low) + n + 1)
    for i, v in enumerate(values):
        highs[(v >> low) + i] = 1
    return varint(n) + bytes([low]) + lows.bytes() + wire.pack_mask(highs)


def elias_fano_size(n: int) -> int:
    """Bytes of write_elias_fano for so many values."""
    low = low_bits(n)
    return wire.varint_size(n) + 1 - (-n * low // 8) - (-((UNIVERSE - 1 >> low) + n + 1) // 8)


def read_elias_fano(r: Bytes) -> list[int]:
    n = r.varint()
    if not 1 <= n <= UNIVERSE or r.byte() != low_bits(n):
        raise FormatError("NonCanonical", "elias-fano")
    low = low_bits(n)
    lows = wire.read_mask(r, n * low)
    highs = np.flatnonzero(wire.read_mask(r, (UNIVERSE - 1 >> low) + n + 1))
    if len(highs) != n:
        raise FormatError("NonCanonical", "elias-fano")
    digits = np.array(lows, np.int64).reshape(n, low)
    found = ((highs - np.arange(n) << low) + digits @ (1 << np.arange(low)[::-1])).tolist()
    if any(b <= a for a, b in zip(found, found[1:])) or found[-1] >= UNIVERSE:
        raise FormatError("NonCanonical", "elias-fano")
    return found


TERRAIN = {"delete_run": (1, "start:v length:v", 4), "delete_box": (2, "origin:vvv size:vvv", 8), "layer": (3, "y:v", 44), "elias_fano": (4, "", 20)}


def write_terrain(program: TerrainProgram) -> bytes:
    out = head("terrain_delta") + varint(wire.zigzag(program.min_y)) + varint(len(program.ops))
    for op in program.ops:
        code, spec, _ = TERRAIN[op["op"]]
        out += bytes([code]) + P._write_fields(op, spec)
        out += wire.pack_mask(op["mask"]) if op["op"] == "layer" else write_elias_fano(op["values"]) if op["op"] == "elias_fano" else b""
    return out + _patches(program.patches)


def read_terrain(data: bytes) -> TerrainProgram:
    r = Bytes(data)
    _check_head(r, "terrain_delta")
    min_y, ops = r.signed(), []
    codes = {code: (name, spec) for name, (code, spec, _) in TERRAIN.items()}
    count = r.varint()
    if count > K.LIMITS["max_commands"][0]:
        raise FormatError("ResourceLimit", "commands")
    for _ in range(count):
        code = r.byte()
        if code not in codes:
            raise FormatError("UnknownOpcode", "terrain-opcode")
        name, spec = codes[code]
        op = {"op": name, **P._read_fields(r, spec)}
        if name == "layer":
            op["mask"] = wire.read_mask(r, 256)
        if name == "elias_fano":
            op["values"] = read_elias_fano(r)
        ops.append(op)
    patches = _read_patches(r, 2, False)
    r.end()
    return TerrainProgram(min_y, ops, patches)


def run_terrain(program: TerrainProgram, limits: dict | None = None) -> tuple[set[int], int]:
    """The deleted cells, and the units."""
    most = {k: v[0] for k, v in K.LIMITS.items()} | (limits or {})
    gone: set[int] = set()
    units = writes = 0
    for op in program.ops:
        name, base = op["op"], TERRAIN[op["op"]][2]
        if name == "delete_run":
            if not op["length"] or op["start"] + op["length"] > UNIVERSE:
                raise FormatError("OutOfBounds", "run")
            n = op["length"]
            if n > most["max_op_expansion"]:
                raise FormatError("ResourceLimit", "expansion")
            cells = range(op["start"], op["start"] + n)
        elif name == "delete_box":
            cells = P.ids_in(K.TERRAIN_GRID, op["origin"], op["size"])
        elif name == "layer":
            if op["y"] >= K.TERRAIN_GRID[1] or not any(op["mask"]):
                raise FormatError("OutOfBounds", "layer")
            cells = [op["y"] * 256 + i for i, bit in enumerate(op["mask"]) if bit]
        else:
            cells = op["values"]
            base += (UNIVERSE - 1 >> low_bits(len(cells))) + len(cells) + 1
        gone.update(cells)
        units += base + len(cells)
        writes += len(cells)
        if len(cells) > most["max_op_expansion"] or writes > most["max_writes"]:
            raise FormatError("ResourceLimit", "writes")
    for i, kind in program.patches:
        if (i in gone) == (kind == 0):
            raise FormatError("NonCanonical", "patch")
        (gone.add if kind == 0 else gone.discard)(i)
        units += 5
    return gone, units


def terrain_canonical(min_y: int, cells: set[int]) -> bytes:
    ids = sorted(cells)
    gaps = np.diff(np.array(ids, np.int64), prepend=-1) - 1
    if (gaps < 0).any():
        raise FormatError("NonCanonical", "order")
    return varint(wire.zigzag(min_y)) + varint(len(ids)) + wire.varints(gaps)


def read_account(data: bytes) -> tuple[int, set[int]]:
    """A terrain account: (min_y, deleted cells) of 24-bit records."""
    if data[:4] != K.ACCOUNT_MAGIC.encode() or len(data) < 16:
        raise FormatError("InvalidEncoding", "magic")
    count, capacity = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[4] != 1:
        raise FormatError("UnsupportedVersion", "account")
    if capacity > 2048 or count > capacity or len(data) != 16 + 3 * capacity:
        raise FormatError("Truncated", "account")
    # Four bits of x, four of z and nine of y are the cell's number.
    found = np.frombuffer(data, np.uint8, 3 * count, 16).reshape(count, 3).astype(np.int64) @ (1, 1 << 8, 1 << 16)
    if (found >> 17).any():
        raise FormatError("NonCanonical", "record")
    return int.from_bytes(data[10:12], "little", signed=True), set(found.tolist())


# ---- forged items --------------------------------------------------------------------------

#: A component's commands: solid, cut_box, extrude, rle, symmetry, sparse; base units.
FORGE = {"solid": (1, 4), "cut_box": (2, 8), "extrude": (3, 10), "rle": (4, 8), "symmetry": (5, 8), "sparse": (6, 6)}


def run_lengths(cells: set[int]) -> tuple[int, list[int]]:
    turns = sorted({j for i in cells for j in (i, i + 1) if (j in cells) != (j - 1 in cells)} - {0, CELLS})
    return int(0 in cells), [b - a for a, b in zip([0, *turns], [*turns, CELLS])]


def write_forge(item: Forged, ops: list[list[dict]], patches: list[list[tuple]]) -> bytes:
    """ops and patches by component; appearance is written as it is."""
    out = head("forged_item") + item.head()
    if item.appearance is not None:
        return out + appearance_bytes(item.appearance)
    out += varint(len(item.components))
    for c, listed, fixes in zip(item.components, ops, patches):
        out += component_head(c) + varint(len(listed))
        for op in listed:
            out += bytes([FORGE[op["op"]][0]])
            if op["op"] == "cut_box":
                out += bytes(op["origin"]) + bytes(op["size"])
            elif op["op"] == "extrude":
                out += bytes([op["axis"]]) + wire.pack_mask(op["mask"])
            elif op["op"] == "rle":
                first, lengths = run_lengths(op["cells"])
                out += bytes([first]) + varint(len(lengths)) + b"".join(map(varint, lengths))
            elif op["op"] == "symmetry":
                out += bytes([op["axis"]])
            elif op["op"] == "sparse":
                out += varint(len(op["cells"])) + b"".join(map(varint, wire.gaps(sorted(op["cells"]))))
        out += _patches(fixes) + paint_bytes(c.paint)
    return out


def run_forge(ops: list[dict], patches: list[tuple]) -> tuple[set[int], int]:
    """A component's cells, and the units."""
    cells: set[int] = set()
    units = 0
    for op in ops:
        name, base = op["op"], FORGE[op["op"]][1]
        before = len(cells)
        if name == "solid":
            cells, writes = set(range(CELLS)), CELLS
        elif name == "cut_box":
            (x, y, z), (w, h, d) = op["origin"], op["size"]
            box = {cell_id(x + i, y + j, z + k) for i in range(w) for j in range(h) for k in range(d)}
            cells, writes = cells - box, len(box)
        elif name == "extrude":
            made = extruded(op["axis"], op["mask"])
            cells, writes, base = cells | set(made), len(made), base + tangent_area(op["axis"])
        elif name == "rle":
            cells, writes, base = cells | op["cells"], len(op["cells"]), base + len(run_lengths(op["cells"])[1])
        elif name == "symmetry":
            grid = K.FORGE_GRID
            split = lambda c: [c % grid[0], c // grid[0] % grid[1], c // (grid[0] * grid[1])]
            made = {cell_id(*(grid[k] - 1 - v if k == op["axis"] else v for k, v in enumerate(split(c)))) for c in cells}
            cells = cells | made
            writes = len(cells) - before
        else:
            cells, writes, base = cells | set(op["cells"]), len(op["cells"]), base + len(op["cells"])
        units += base + writes
    for i, kind in patches:
        if (i in cells) == (kind == 0):
            raise FormatError("NonCanonical", "patch")
        (cells.add if kind == 0 else cells.discard)(i)
        units += 5
    return cells, units


def _read_grip(r: Bytes) -> tuple | None:
    flag = r.byte()
    if flag > 1:
        raise FormatError("NonCanonical", "grip-flag")
    if not flag:
        return None
    offset = tuple(r.signed() for _ in range(3))
    axis, sign, rotation = r.take(3)
    if axis > 2 or sign > 1 or rotation > 3:
        raise FormatError("OutOfBounds", "grip")
    return offset, axis, 1 if sign else -1, rotation


def _read_quads(r: Bytes, width: int, most: int) -> list[tuple]:
    """Quads of so many bytes and a colour, in strict order."""
    count = r.varint()
    if count > most:
        raise FormatError("ResourceLimit", "quads")
    found = [(*r.take(width), int.from_bytes(r.take(2), "little")) for _ in range(count)]
    if any(b <= a for a, b in zip(found, found[1:])) or any(q[0] > 2 or q[1] > 1 or q[-1] > 0xFFF for q in found):
        raise FormatError("NonCanonical", "quads")
    return found


def _read_forge_op(r: Bytes) -> dict:
    names = {code: name for name, (code, _) in FORGE.items()}
    code = r.byte()
    if code not in names:
        raise FormatError("UnknownOpcode", "forge-opcode")
    op: dict = {"op": names[code]}
    if op["op"] == "cut_box":
        op["origin"], op["size"] = tuple(r.take(3)), tuple(r.take(3))
        if any(not s or o + s > g for o, s, g in zip(op["origin"], op["size"], K.FORGE_GRID)):
            raise FormatError("OutOfBounds", "cut-box")
    elif op["op"] in ("extrude", "symmetry"):
        op["axis"] = r.byte()
        if op["axis"] > 2:
            raise FormatError("OutOfBounds", "axis")
        if op["op"] == "extrude":
            op["mask"] = wire.read_mask(r, tangent_area(op["axis"]))
    elif op["op"] == "rle":
        value, at, cells = r.byte(), 0, set()
        if value > 1:
            raise FormatError("NonCanonical", "rle")
        for _ in range(r.varint()):
            n = r.varint()
            if not n or at + n > CELLS:
                raise FormatError("OutOfBounds", "rle")
            cells |= set(range(at, at + n)) if value else set()
            at, value = at + n, 1 - value
        if at != CELLS:
            raise FormatError("Truncated", "rle")
        op["cells"] = cells
    elif op["op"] == "sparse":
        op["cells"] = set(wire.read_gaps(r, r.varint()))
        if any(c >= CELLS for c in op["cells"]):
            raise FormatError("OutOfBounds", "sparse")
    return op


def read_forge_program(data: bytes) -> tuple[Forged, list[list[dict]], list[list[tuple]], int]:
    """A forged item as its program makes it, its components' commands and patches, and the units."""
    r = Bytes(data)
    _check_head(r, "forged_item")
    item = Forged(int.from_bytes(r.take(2), "little"), int.from_bytes(r.take(2), "little"), r.take(12))
    mode, units, most = r.byte(), 0, K.LIMITS["max_patches"][0]
    listed, fixes = [], []
    if mode > 1 or any(a > 63 for a in item.attributes):
        raise FormatError("OutOfBounds", "equipment")
    if mode:
        dims = tuple(r.varint() for _ in range(3))
        if any(d % 2 or not 2 <= d <= 1022 for d in dims):
            raise FormatError("OutOfBounds", "appearance-dimensions")
        grip = _read_grip(r)
        quads = _read_quads(r, 8, min(most, 4095))
        if not quads:
            raise FormatError("NonCanonical", "appearance")
        item.appearance, units = (dims, grip, quads), 13 * len(quads)
    else:
        for _ in range(r.varint()):
            resource, colour, dims = r.byte(), int.from_bytes(r.take(2), "little"), tuple(r.take(3))
            if resource >= len(K.RESOURCE_COLOURS) or colour > 0xFFF or not all(dims):
                raise FormatError("OutOfBounds", "component")
            offset, grip = tuple(r.signed() for _ in range(3)), _read_grip(r)
            ops = [_read_forge_op(r) for _ in range(r.varint())]
            patches = _read_patches(r, 2, False)
            cells, used = run_forge(ops, patches)
            paint = _read_quads(r, 7, most)
            if not cells or max(cells) >= CELLS:
                raise FormatError("OutOfBounds", "cells")
            item.components.append(Component(resource, colour, dims, offset, grip, sorted(cells), paint))
            units += used + 11 * len(paint)
            listed.append(ops)
            fixes.append(patches)
    r.end()
    return item, listed, fixes, units


def read_forge(data: bytes) -> tuple[Forged, int]:
    """A forged item as its program makes it, and the units."""
    item, _, _, units = read_forge_program(data)
    return item, units
