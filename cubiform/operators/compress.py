"""Deterministic candidate encodings of single assets: the smallest of several covers."""

from __future__ import annotations

import numpy as np

from .. import constants as K
from ..sources import candidates as C
from ..sources import forged as G
from ..sources import programs as P
from ..sources import wire


def grown_boxes(cells: dict[int, int], grid: tuple[int, int, int], to_id, to_xyz, order: tuple[int, int, int], most: int | None = None) -> list[tuple[int, tuple, tuple]]:
    """Disjoint boxes of one value that cover the cells: from each first cell grown along each axis in order.

    With most, whoever has no use for more boxes than that gets one more than that at the latest, and no cover.
    """
    left, found = dict(cells), []
    steps = [to_id(*(int(k == axis) for k in range(3))) for axis in range(3)]  # to_id is linear
    for i in sorted(cells):
        if i not in left:
            continue
        if most is not None and len(found) > most:
            break
        value, start, size, body = left[i], to_xyz(i), [1, 1, 1], [i]
        for axis in order:
            step, room = steps[axis], grid[axis] - start[axis]
            face = body  # the cells of the last slice across this axis
            while size[axis] < room:
                face = [j + step for j in face]
                if any(left.get(j) != value for j in face):
                    break
                size[axis] += 1
                body = body + face
        for j in body:
            del left[j]
        found.append((value, start, tuple(size)))
    return found


def terrain(min_y: int, cells: set[int]) -> bytes:
    """The smallest of: patches, a split code, long runs, full layers, a bounding box, grown boxes."""
    ids, runs = sorted(cells), []
    for i in ids:
        if runs and runs[-1][0] + runs[-1][1] == i:
            runs[-1][1] += 1
        else:
            runs.append([i, 1])
    layers: dict[int, list[int]] = {}
    for i in ids:
        layers.setdefault(i // 256, []).append(i % 256)
    size = wire.varint_size
    empty = len(C.head("terrain_delta")) + size(wire.zigzag(min_y))
    whole = _patch_bytes(ids)
    #: Bytes, commands, and the patches' cells and kind: sizes are counted, and the smallest alone are written.
    tries: list[tuple] = []

    def add(op_bytes: int, count: int, ops, patched: list[int], kind: int = 0) -> None:
        if count <= K.LIMITS["max_commands"][0]:
            tries.append((empty + size(count) + op_bytes + (whole if patched is ids else _patch_bytes(patched)), ops, patched, kind))

    add(0, 0, list, ids)
    if ids:
        add(1 + C.elias_fano_size(len(ids)), 1, lambda: [{"op": "elias_fano", "values": ids}], [])
    for least in (1, 2, 3, 4):
        long = [(s, n) for s, n in runs if n >= least]
        short = [i for s, n in runs if n < least for i in range(s, s + n)] if long else ids
        add(sum(1 + size(s) + size(n) for s, n in long), len(long), lambda long=long: [{"op": "delete_run", "start": s, "length": n} for s, n in long], short)
    for least in (1, 32, 64, 128):
        full = [y for y, b in layers.items() if len(b) >= least]
        rest = [256 * y + p for y, b in layers.items() if len(b) < least for p in b] if full else ids
        mask = lambda y: [int(p in b) for b in (set(layers[y]),) for p in range(256)]
        add(sum(33 + size(y) for y in full), len(full), lambda full=full: [{"op": "layer", "y": y, "mask": mask(y)} for y in full], rest)
    split = [(i % 16, i // 256, i // 16 % 16) for i in ids]
    if split:
        low, high = [min(c) for c in zip(*split)], [max(c) for c in zip(*split)]
        extent = tuple(h - a + 1 for a, h in zip(low, high))
        # A patch has two bytes at least: a box with that many cells too many is not made, as it can't be the smallest.
        if 2 * (extent[0] * extent[1] * extent[2] - len(ids)) <= min(t[0] for t in tries):
            spare = sorted(set(P.ids_in(K.TERRAIN_GRID, tuple(low), extent)) - cells)
            add(1 + sum(map(size, (*low, *extent))), 1, lambda: [{"op": "delete_box", "origin": tuple(low), "size": extent}], spare, 1)
        # A cell without neighbours is a box, of seven bytes at least: with too many of those, boxes can't be the smallest.
        alone = sum(cells.isdisjoint((i - 1, i + 1, i - 16, i + 16, i - 256, i + 256)) for i in ids)
    if split and empty + 7 * alone <= min(t[0] for t in tries):
        boxes = grown_boxes(dict.fromkeys(ids, 1), K.TERRAIN_GRID, lambda x, y, z: x + 16 * (z + 16 * y), lambda i: (i % 16, i // 256, i // 16 % 16), (0, 2, 1))
        add(sum(1 + sum(map(size, (*o, *s))) for _, o, s in boxes), len(boxes), lambda: [{"op": "delete_box", "origin": o, "size": s} for _, o, s in boxes], [])
    least = min(t[0] for t in tries)
    return min(C.write_terrain(C.TerrainProgram(min_y, ops(), [(i, kind) for i in patched])) for n, ops, patched, kind in tries if n == least)


def _patch_bytes(ids: list[int]) -> int:
    """Bytes of patches without materials at these cells, in order, and of their number."""
    far, at = 0, np.array([-1, *ids])
    gaps = at[1:] - at[:-1] - 1
    for k in range(1, 5):
        far += np.count_nonzero(gaps >= 1 << 7 * k)
    return wire.varint_size(len(ids)) + 2 * len(ids) + far


def slice_masks(scene: P.Scene, axis: int) -> dict[int, list[int]]:
    """By material, which cells of the first slice across an axis it fills: u + u_length * v of the tangents."""
    a, b = P.TANGENTS[axis]
    sx, sy, sz = scene.size
    masks: dict[int, list[int]] = {}
    for i, m in sorted(scene.voxels.items()):
        at = (i % sx, i // (sx * sz), i // sx % sz)
        if not at[axis]:
            masks.setdefault(m, [0] * (scene.size[a] * scene.size[b]))[at[a] + scene.size[a] * at[b]] = 1
    return dict(sorted(masks.items()))


def building(scene: P.Scene) -> bytes:
    """The smallest of: patches, a literal, grown boxes, runs along an axis, a box or an extruded first slice for each material."""
    sx, sy, sz = scene.size
    to_id, to_xyz = lambda x, y, z: x + sx * (z + sz * y), lambda i: (i % sx, i // (sx * sz), i // sx % sz)
    size, ids, voxels = wire.varint_size, sorted(scene.voxels), scene.voxels
    #: The least that a try's commands and patches can take, and its commands: as many tries are run as can be the smallest.
    tries: list[tuple] = []

    def add(op_bytes: int, ops: list[dict], patch_bytes: int) -> None:
        if len(ops) <= K.LIMITS["max_commands"][0]:
            tries.append((size(len(ops)) + op_bytes + patch_bytes, ops))

    def patched(cells: list[int]) -> int:
        return size(len(cells)) + sum(1 + size(i - before - 1) + size(voxels[i]) for before, i in zip([-1, *cells], cells))

    def boxed(kind: str, m: int, o: tuple, s: tuple) -> dict:
        return {"op": kind, "material": m, "origin": o, "size": s}

    def box_bytes(ops: list[dict]) -> int:
        return sum(1 + sum(map(size, (op["material"], *op["origin"], *op["size"]))) for op in ops)

    add(0, [], patched(ids))
    add(1 + patched(ids) - len(ids), [{"op": "literal", "voxels": dict(voxels)}], 1)
    ops = [boxed("box", *found) for found in grown_boxes(voxels, scene.size, to_id, to_xyz, (0, 2, 1))]
    add(box_bytes(ops), ops, 1)
    for axis, step in enumerate((1, sx * sz, sx)):
        # A run or a single cell has three bytes at least, and neighbours across an edge make fewer of them.
        if 2 + 3 * sum(voxels.get(i - step) != m for i, m in voxels.items()) > min(t[0] for t in tries):
            continue
        runs = grown_boxes(voxels, scene.size, to_id, to_xyz, (axis,))
        ops = [{"op": "run", "material": m, "origin": o, "axis": axis, "length": s[axis]} for m, o, s in runs if s[axis] > 1]
        single = [to_id(*o) for _, o, s in runs if s[axis] == 1]
        add(sum(2 + sum(map(size, (op["material"], *op["origin"], op["length"]))) for op in ops), ops, patched(single))
    around: dict[int, list[tuple]] = {}
    for i, m in voxels.items():
        around.setdefault(m, []).append(to_xyz(i))
    ops = [boxed("box", m, tuple(min(c) for c in zip(*at)), tuple(max(c) - min(c) + 1 for c in zip(*at))) for m, at in sorted(around.items())]
    # A patch has three bytes at least, and cells too many are patches.
    add(box_bytes(ops), ops, 1 + 3 * max([P._volume(op["size"]) - len(ids) for op in ops] + [0]))
    for axis in range(3):
        u, v = (scene.size[k] for k in P.TANGENTS[axis])
        first = {m for m, at in around.items() if any(c[axis] == 0 for c in at)}
        if first and (9 - (-u * v // 8)) * len(first) <= min(t[0] for t in tries):
            masks = slice_masks(scene, axis)
            ops = [{"op": "extrude", "material": m, "origin": (0, 0, 0), "axis": axis, "u": u, "v": v, "depth": scene.size[axis], "mask": mask} for m, mask in masks.items()]
            add((9 - (-u * v // 8)) * len(ops), ops, 0)
    best, head = None, len(C.head("building")) + sum(map(size, scene.size))
    for least, ops in sorted(tries, key=lambda t: t[0]):
        if best is not None and head + least > len(best):
            break
        try:
            have = C.run_building(P.Program(scene.size, ops)).voxels
        except wire.FormatError:  # an extrusion may write more than the limits allow
            continue
        data = C.write_building(P.Program(scene.size, ops, [], P.difference(voxels, have)))
        if best is None or (len(data), data) < (len(best), best):
            best = data
    return best


def forged(item: G.Forged) -> bytes:
    """For each component the smallest of: sparse, run lengths, solid, an extrusion, a symmetric half, cut boxes."""
    ops, fixes, varint_size = [], [], wire.varint_size
    for c in item.components:
        want, cells = set(c.cells), sorted(c.cells)
        half = [i for i in cells if i % G.GX < G.GX // 2]
        listed = lambda ids: varint_size(len(ids)) + sum(map(varint_size, wire.gaps(ids)))
        _, lengths = C.run_lengths(want)
        best, one = 1 + 1 + listed(cells) + 1, [{"op": "sparse", "cells": want}]

        def attempt(op_bytes: int, made: list[dict], wrong: int) -> None:
            """Takes a try that is smaller; with so many cells wrong, of two bytes each at least, only one that can be is run."""
            nonlocal best, one
            least = varint_size(len(made)) + op_bytes + varint_size(wrong)  # noqa: B023
            if least + 2 * wrong < best:
                size = least + sum(1 + varint_size(g) for g in wire.gaps(sorted(want ^ C.run_forge(made, [])[0])))  # noqa: B023
                if size < best:
                    best, one = size, made

        attempt(2 + varint_size(len(lengths)) + sum(map(varint_size, lengths)), [{"op": "rle", "cells": want}], 0)
        attempt(1, [{"op": "solid"}], G.CELLS - len(want))
        for axis in range(3):
            a, b = P.TANGENTS[axis]
            mask = [0] * C.tangent_area(axis)
            for cell in cells:
                at = (cell % G.GX, cell // G.GX % G.GY, cell // (G.GX * G.GY))
                mask[at[a] + K.FORGE_GRID[a] * at[b]] = 1
            attempt(2 - (-len(mask) // 8), [{"op": "extrude", "axis": axis, "mask": mask}], sum(mask) * K.FORGE_GRID[axis] - len(want))
        if half:
            rows, middle = [i // G.GX * G.GX for i in half], G.GX - 1
            both = {*half, *(2 * row + middle - i for row, i in zip(rows, half))}
            attempt(1 + listed(half) + 2, [{"op": "sparse", "cells": set(half)}, {"op": "symmetry", "axis": 0}], len(both ^ want))
        # A hole has seven bytes: where there are too many for the smallest, they needn't be known.
        most = min(31, (best - 4) // 7)
        holes = grown_boxes(dict.fromkeys(set(range(G.CELLS)) - want, 1), K.FORGE_GRID, G.cell_id, lambda i: (i % G.GX, i // G.GX % G.GY, i // (G.GX * G.GY)), (0, 1, 2), most)
        if len(holes) <= most:
            attempt(1 + 7 * len(holes), [{"op": "solid"}, *({"op": "cut_box", "origin": o, "size": s} for _, o, s in holes)], 0)
        have, _ = C.run_forge(one, [])
        patch = sorted([(i, 0) for i in want - have] + [(i, 1) for i in have - want])
        ops.append(one)
        fixes.append(patch)
    return C.write_forge(item, ops, fixes)
