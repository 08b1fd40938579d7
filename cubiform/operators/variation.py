"""How programs vary: the families of programs that a search can breed, each with its target.

A family reads encodings, mutates and crosses programs, tidies them, and makes them exact again. The
compact family has the buildings of the compact format, the others the programs of the first machine.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from .. import constants as K
from ..sources import candidates as C
from ..sources import envelopes as E
from ..sources import forged as G
from ..sources import programs as P
from ..sources import wire
from ..sources.wire import FormatError
from . import random

Made = tuple[int, int, bytes]


def _near(ops: list, rng: random.ChaCha8) -> int:
    return rng.below(len(ops))


def _swapped(ops: list, rng: random.ChaCha8) -> list:
    if len(ops) < 2:
        return ops
    out, i, j = list(ops), _near(ops, rng), _near(ops, rng)
    out[i], out[j] = out[j], out[i]
    return out


def _without(ops: list, i: int) -> list:
    return ops[:i] + ops[i + 1 :]


def _spliced(a: list, b: list, rng: random.ChaCha8) -> list:
    """The beginning of one list and the end of another."""
    return a[: rng.below(len(a) + 1)] + b[rng.below(len(b) + 1) :]


def _distinct(ops: list) -> list:
    seen, out = set(), []
    for op in ops:
        key = json.dumps(op, sort_keys=True, default=sorted)
        if key not in seen:
            seen.add(key)
            out.append(op)
    return out


# ---- the compact format --------------------------------------------------------------------


def _boxes_to_repeat(ops: list[dict]) -> list[dict]:
    """Two boxes of one material and size become a repetition."""
    for i, a in enumerate(ops):
        for j in range(i + 1, len(ops)):
            b = ops[j]
            if a["op"] == b["op"] == "box" and (a["material"], a["size"]) == (b["material"], b["size"]) and a["origin"] != b["origin"]:
                delta = tuple(y - x for x, y in zip(a["origin"], b["origin"]))
                if all(abs(d) <= 256 for d in delta):
                    return [*ops[:i], {"op": "repeat_box", "material": a["material"], "origin": a["origin"], "size": a["size"], "count": 2, "delta": delta}, *ops[i + 1 : j], *ops[j + 1 :]]
    return ops


def _thin_box(op: dict) -> dict:
    """A box one cell wide in two directions is a run; in one, a wall."""
    thin = [k for k in range(3) if op["size"][k] == 1]
    if len(thin) >= 2:
        axis = next((k for k in range(3) if k not in thin), 0)
        return {"op": "run", "material": op["material"], "origin": op["origin"], "axis": axis, "length": op["size"][axis]}
    if len(thin) == 1:
        u, v = P.TANGENTS[thin[0]]
        return {"op": "wall", "material": op["material"], "origin": op["origin"], "axis": thin[0], "u": op["size"][u], "v": op["size"][v], "thickness": 1}
    return op


def _split(op: dict, rng: random.ChaCha8) -> list[dict]:
    wide = [k for k in range(3) if op["size"][k] > 1]
    if not wide:
        return [op]
    axis = wide[rng.below(len(wide))]
    at = 1 + rng.below(op["size"][axis] - 1)
    low, high, origin = list(op["size"]), list(op["size"]), list(op["origin"])
    low[axis], high[axis] = at, op["size"][axis] - at
    origin[axis] += at
    return [{**op, "size": tuple(low)}, {**op, "origin": tuple(origin), "size": tuple(high)}]


def _region(program: P.Program, rng: random.ChaCha8) -> tuple[tuple, tuple]:
    size = tuple(1 + rng.below(min(s, 8)) for s in program.size)
    return tuple(rng.below(s - e + 1) for s, e in zip(program.size, size)), size


def _appended(kind: str, program: P.Program, rng: random.ChaCha8) -> dict:
    at, size = _region(program, rng)
    delta = tuple(rng.below(17) - 8 for _ in range(3))
    material = program.palette[rng.below(len(program.palette))]
    made = {
        "translate": lambda: {"source": at, "size": size, "delta": delta}, "rotate_y": lambda: {"source": at, "size": size, "target": at, "turns": 1 + rng.below(3)},
        "mirror": lambda: {"source": at, "size": size, "target": at, "axis": rng.below(3)}, "repeat_region": lambda: {"source": at, "size": size, "count": 2 + rng.below(3), "delta": delta},
        "clear_box": lambda: {"origin": at, "size": size}, "gable": lambda: {"material": material, "style": rng.below(3), "z_oriented": rng.below(2), "origin": at, "width": size[0], "depth": size[2]},
        "tree": lambda: {"material": material, "leaf": material, "origin": at, "height": 2 + rng.below(6), "crown": 1 + rng.below(2)},
        "fence": lambda: {"material": material, "origin": at, "axis": rng.below(2), "length": size[0], "spacing": 1 + rng.below(4)},
    }[kind]()
    return {"op": kind, **made}


APPENDED = ("translate", "rotate_y", "mirror", "repeat_region", "clear_box", "gable", "tree", "fence")
MUTATIONS = ("remove", "swap", "thin", "split", "combine", "shrink", "fewer", "mask", *APPENDED, "repeat")


def mutate(program: P.Program, rng: random.ChaCha8, kind: str | None = None) -> P.Program:
    """One change of the commands; what it can't apply to, it leaves. The residual makes up for the rest."""
    ops = list(program.ops)
    kind = kind or MUTATIONS[rng.u32() % len(MUTATIONS)]
    if not ops and kind not in APPENDED:
        return program
    i = rng.below(len(ops))
    if kind == "remove":
        del ops[i]
    elif kind == "swap":
        j = rng.below(len(ops))
        ops[i], ops[j] = ops[j], ops[i]
    elif kind in ("combine", "repeat"):
        ops = _boxes_to_repeat(ops)
    elif kind in APPENDED:
        ops.append(_appended(kind, program, rng))
    elif kind == "fewer" and ops[i]["op"] == "repeat_box":
        ops[i] = {**ops[i], "count": max(2, ops[i]["count"] - 1)}
    elif ops[i]["op"] == "box":
        if kind == "thin":
            ops[i] = _thin_box(ops[i])
        elif kind == "split":
            ops[i : i + 1] = _split(ops[i], rng)
        elif kind == "shrink":
            axis = rng.below(3)
            ops[i] = {**ops[i], "size": tuple(max(1, s - 1) if k == axis else s for k, s in enumerate(ops[i]["size"]))}
        elif kind == "mask":
            axis = rng.below(3)
            u, v = (ops[i]["size"][k] for k in P.TANGENTS[axis])
            ops[i] = {"op": "extrude", "material": ops[i]["material"], "origin": ops[i]["origin"], "axis": axis, "u": u, "v": v, "depth": ops[i]["size"][axis], "mask": [1] * (u * v)}
    return P.Program(program.size, ops, program.palette)


def tidy(program: P.Program) -> P.Program:
    """Without repeated commands; the first of each stays."""
    return P.Program(program.size, _distinct(program.ops), program.palette)


def cross(a: P.Program, b: P.Program, rng: random.ChaCha8) -> P.Program:
    """The beginning of one program and the end of another."""
    return P.Program(a.size, _spliced(a.ops, b.ops, rng), a.palette)


def evaluate(program: P.Program, target: P.Scene) -> tuple[int, int, bytes] | None:
    """(bytes, units, encoding) of the program made exact, and read back to be sure; None if it can't be."""
    try:
        data = P.encode(P.exactify(program, target))
        scene = P.execute(P.decode(data))
    except (FormatError, KeyError):
        return None
    return (len(data), scene.units, data) if scene.voxels == target.voxels else None


def rank_key(program: P.Program, target: P.Scene) -> tuple:
    """What orders programs before they are evaluated, but for their index: see population.rank_key."""
    try:
        have = P.execute(P.Program(program.size, program.ops)).voxels
    except (FormatError, KeyError):
        return (1, 0, 0, len(program.ops))
    differ = P.difference(target.voxels, have)
    sets, paints = (sum(kind == k for _, kind, _ in differ) for k in (0, 2))
    volume = program.size[0] * program.size[1] * program.size[2]
    residual = min(3 * len(differ) + sets + paints, 6 * len(P._stretches(differ)), -(-volume // 8) + 2 * paints)
    masks = sum(-(-len(op.get("mask", ())) // 8) for op in program.ops)
    return (0, 6 * len(program.ops) + masks + residual, len(differ), len(program.ops))


class Compact:
    """Buildings of the compact format."""

    profile = "building"

    def __init__(self, target: P.Scene):
        self.target = P.Scene(target.size, target.voxels)
        self._last: dict[bytes, P.Program] = {}

    def read(self, data: bytes) -> P.Program:
        """A parent breeds more than once, so the last ones are kept; commands are replaced and never changed."""
        if data not in self._last:
            if len(self._last) >= 64:
                self._last.clear()
            self._last[data] = P.decode(data)
        found = self._last[data]
        return P.Program(found.size, list(found.ops), found.palette)

    def evaluate(self, program: P.Program) -> Made | None:
        return evaluate(program, self.target)

    def mutate(self, program: P.Program, rng: random.ChaCha8, kind: str | None = None) -> P.Program:
        return mutate(program, rng, kind)

    def cross(self, a: P.Program, b: P.Program, rng: random.ChaCha8) -> P.Program:
        return cross(a, b, rng)

    def tidy(self, program: P.Program) -> P.Program:
        return tidy(program)

    def rank(self, program: P.Program) -> tuple:
        return rank_key(program, self.target)


# ---- the first machine ---------------------------------------------------------------------


class Terrain:
    """Deletions of a terrain."""

    profile = "terrain_delta"

    def __init__(self, min_y: int, cells: set[int]):
        self.min_y, self.cells, self.ids = min_y, cells, sorted(cells)

    def read(self, data: bytes) -> list[dict]:
        return C.read_terrain(data).ops

    def evaluate(self, ops: list[dict]) -> Made | None:
        try:
            have, _ = C.run_terrain(C.TerrainProgram(self.min_y, ops))
            patches = sorted([(i, 0) for i in self.cells - have] + [(i, 1) for i in have - self.cells])
            data = C.write_terrain(C.TerrainProgram(self.min_y, ops, patches))
            cells, units = C.run_terrain(C.read_terrain(data))
        except FormatError:
            return None
        return (len(data), units, data) if cells == self.cells else None

    def _place(self, rng: random.ChaCha8) -> tuple[int, tuple]:
        i = self.ids[_near(self.ids, rng)]
        return i, (i % 16, i // 256, i // 16 % 16)

    def _run(self, ops: list, rng: random.ChaCha8) -> list:
        start, _ = self._place(rng)
        return [*ops, {"op": "delete_run", "start": start, "length": min(1 + rng.below(32), C.UNIVERSE - start)}]

    def _box(self, ops: list, rng: random.ChaCha8) -> list:
        _, at = self._place(rng)
        return [*ops, {"op": "delete_box", "origin": at, "size": tuple(min(1 + rng.below(n), g - a) for n, g, a in zip((4, 8, 4), K.TERRAIN_GRID, at))}]

    def _layer(self, ops: list, rng: random.ChaCha8) -> list:
        _, (_, y, _) = self._place(rng)
        mask = [0] * 256
        for i in self.ids:
            if i // 256 == y:
                mask[i % 256] = 1
        return [*ops, {"op": "layer", "y": y, "mask": mask}]

    def _split_code(self, ops: list, rng: random.ChaCha8) -> list:
        return [*(op for op in ops if op["op"] != "elias_fano"), {"op": "elias_fano", "values": self.ids}]

    def mutate(self, ops: list[dict], rng: random.ChaCha8) -> list[dict]:
        if not self.ids:
            return []
        drop = lambda o, r: _without(o, _near(o, r)) if o else o
        kinds: tuple[Callable, ...] = (drop, self._run, self._box, self._layer, self._split_code, _swapped)
        return kinds[rng.u32() % len(kinds)](ops, rng)

    def cross(self, a: list[dict], b: list[dict], rng: random.ChaCha8) -> list[dict]:
        return _spliced(a, b, rng)

    def tidy(self, ops: list[dict]) -> list[dict]:
        """Runs that follow each other become one."""
        out: list[dict] = []
        for op in ops:
            last = out[-1] if out else None
            if last and last["op"] == op["op"] == "delete_run" and last["start"] + last["length"] == op["start"]:
                out[-1] = {**last, "length": last["length"] + op["length"]}
            elif op not in out:
                out.append(op)
        return out


class Building:
    """Buildings of the first machine."""

    profile = "building"

    def __init__(self, scene: P.Scene):
        self.size, self.voxels, self.ids = scene.size, scene.voxels, sorted(scene.voxels)

    def read(self, data: bytes) -> list[dict]:
        return C.read_building(data).ops

    def evaluate(self, ops: list[dict]) -> Made | None:
        try:
            have = C.run_building(P.Program(self.size, ops)).voxels
            data = C.write_building(P.Program(self.size, ops, [], P.difference(self.voxels, have)))
            scene = C.run_building(C.read_building(data))
        except FormatError:
            return None
        return (len(data), scene.units, data) if scene.voxels == self.voxels else None

    def _reach(self, at: tuple, most: int, rng: random.ChaCha8) -> tuple:
        return tuple(min(1 + rng.below(most), s - a) for s, a in zip(self.size, at))

    def _resized(self, ops: list[dict], rng: random.ChaCha8) -> list[dict]:
        """The first box, a layer thinner or thicker."""
        i = next((i for i, op in enumerate(ops) if op["op"] == "box"), None)
        if i is None:
            return ops
        axis, less, size = rng.below(3), rng.below(2), list(ops[i]["size"])
        if less and size[axis] > 1:
            size[axis] -= 1
        elif ops[i]["origin"][axis] + size[axis] < self.size[axis]:
            size[axis] += 1
        return [*ops[:i], {**ops[i], "size": tuple(size)}, *ops[i + 1 :]]

    def mutate(self, ops: list[dict], rng: random.ChaCha8) -> list[dict]:
        if not self.ids:
            return []
        i = self.ids[_near(self.ids, rng)]
        at, m = (i % self.size[0], i // (self.size[0] * self.size[2]), i // self.size[0] % self.size[2]), self.voxels[i]

        def run() -> dict:
            axis = rng.below(3)
            return {"op": "run", "material": m, "origin": at, "axis": axis, "length": min(1 + rng.below(16), self.size[axis] - at[axis])}

        added = {
            "box": lambda: {"op": "box", "material": m, "origin": at, "size": self._reach(at, 8, rng)}, "run": run, "cut": lambda: {"op": "cut", "origin": at, "size": self._reach(at, 4, rng)},
            "literal": lambda: {"op": "literal", "voxels": {i: m}}, "wall": lambda: {"op": "wall", "material": m, "origin": at, "axis": rng.below(3), "u": 1, "v": 1, "thickness": 1},
        }
        kind = ("drop", "box", "run", "cut", "literal", "resize", "wall", "swap")[rng.u32() % 8]
        if kind == "drop":
            return _without(ops, _near(ops, rng)) if ops else ops
        if kind == "resize":
            return self._resized(ops, rng)
        return _swapped(ops, rng) if kind == "swap" else [*ops, added[kind]()]

    def _x(self, op: dict) -> int:
        if op["op"] == "literal":
            return min(op["voxels"], default=0) % self.size[0]
        return op.get("origin", op.get("source"))[0]

    def cross(self, a: list[dict], b: list[dict], rng: random.ChaCha8) -> list[dict]:
        """What begins left of a plane in one, and right of it in the other."""
        plane = rng.u32() % self.size[0]
        return [op for op in a if self._x(op) <= plane] + [op for op in b if self._x(op) > plane]

    def tidy(self, ops: list[dict]) -> list[dict]:
        """Boxes of one material that share a whole face become one, as long as there are any."""
        return _distinct(joined_boxes(ops))


def joined(a: dict, b: dict) -> dict | None:
    """One box for two of a material that share a whole face."""
    if not (a["op"] == b["op"] == "box" and a["material"] == b["material"]):
        return None
    for axis in range(3):
        if all((a["origin"][k], a["size"][k]) == (b["origin"][k], b["size"][k]) for k in P.TANGENTS[axis]):
            low, high = sorted((a, b), key=lambda op: op["origin"][axis])
            if low["origin"][axis] + low["size"][axis] == high["origin"][axis]:
                return {**low, "size": tuple(s + (high["size"][k] if k == axis else 0) for k, s in enumerate(low["size"]))}
    return None


def joined_boxes(ops: list[dict]) -> list[dict]:
    """The earliest pair of boxes that can be joined is joined in the place of its first, again and again."""
    out = list(ops)
    while True:
        pair = next(((i, j, one) for i in range(len(out)) for j in range(i + 1, len(out)) if (one := joined(out[i], out[j]))), None)
        if pair is None:
            return out
        i, j, one = pair
        out = _without([*out[:i], one, *out[i + 1 :]], j)


class Forge:
    """Forged items; a program is a list of commands for each component."""

    profile = "forged_item"

    def __init__(self, item: G.Forged):
        self.item = item

    def read(self, data: bytes) -> list[list[dict]]:
        return C.read_forge_program(data)[1]

    def evaluate(self, listed: list[list[dict]]) -> Made | None:
        try:
            fixes = []
            for c, ops in zip(self.item.components, listed, strict=True):
                have, _ = C.run_forge(ops, [])
                fixes.append(sorted([(i, 0) for i in set(c.cells) - have] + [(i, 1) for i in have - set(c.cells)]))
            data = C.write_forge(self.item, listed, fixes)
            again, units = C.read_forge(data)
        except (FormatError, ValueError):
            return None
        return (len(data), units, data) if again.canonical() == self.item.canonical() else None

    def _full(self, cells: list[int], axis: int) -> list[int]:
        """The mask of a component's first slice across an axis."""
        a, b = P.TANGENTS[axis]
        mask = [0] * C.tangent_area(axis)
        for i in cells:
            at = (i % G.GX, i // G.GX % G.GY, i // (G.GX * G.GY))
            if not at[axis]:
                mask[at[a] + K.FORGE_GRID[a] * at[b]] = 1
        return mask

    def mutate(self, listed: list[list[dict]], rng: random.ChaCha8) -> list[list[dict]]:
        if not listed:
            return listed
        n = _near(listed, rng)
        ops, cells = listed[n], self.item.components[n].cells
        kind = ("solid", "rle", "sparse", "extrude", "half", "drop", "cut")[rng.u32() % 7]
        sparse = {"op": "sparse", "cells": set(cells)}
        if kind in ("solid", "rle", "sparse"):
            ops = [{"solid": {"op": "solid"}, "rle": {"op": "rle", "cells": set(cells)}, "sparse": sparse}[kind]]
        elif kind == "extrude":
            axis = rng.below(3)
            mask = self._full(cells, axis)
            ops = [{"op": "extrude", "axis": axis, "mask": mask}] if any(mask) else ops
        elif kind == "half":
            axis = rng.below(3)
            half = {i for i in cells if 2 * (i % G.GX, i // G.GX % G.GY, i // (G.GX * G.GY))[axis] < K.FORGE_GRID[axis]}
            ops = [{"op": "sparse", "cells": half}, {"op": "symmetry", "axis": axis}] if half else ops
        elif kind == "drop":
            ops = (_without(ops, _near(ops, rng)) if ops else ops) or [sparse]
        else:
            i = cells[_near(cells, rng)]
            ops = [*ops, {"op": "cut_box", "origin": (i % G.GX, i // G.GX % G.GY, i // (G.GX * G.GY)), "size": (1, 1, 1)}]
        return [*listed[:n], ops, *listed[n + 1 :]]

    def cross(self, a: list[list[dict]], b: list[list[dict]], rng: random.ChaCha8) -> list[list[dict]]:
        return [other if rng.u32() % 2 else _spliced(own, other, rng) for own, other in zip(a, b)]

    def tidy(self, listed: list[list[dict]]) -> list[list[dict]]:
        return [_distinct(ops) for ops in listed]


def machine(target: E.Target, data: bytes) -> Terrain | Building | Forge:
    """The family of the first machine for an asset, given as its meaning and its bytes."""
    if target.profile == "terrain_delta":
        facts = dict(target.facts)
        return Terrain(facts.pop("min_y"), set(facts))
    if target.profile == "building":
        facts = dict(target.facts)
        return Building(P.Scene(facts.pop("size"), facts))
    if wire.detect(data) == K.MACHINE:
        return Forge(C.read_forge(data)[0])
    return Forge(G.read_forged_text(data.decode("latin-1")) if wire.detect(data) == K.FORGED else G.read_forged(data))
