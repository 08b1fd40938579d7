"""Validators: limits, meanings of assets, and what a list of patches may take."""

from __future__ import annotations

from .. import constants as K
from . import programs as P
from .forged import CELLS, Forged
from .wire import FormatError

#: Bytes that one patch is modelled with: an id, a kind and a material, aligned.
PATCH_BYTES = 8
_LEAST_MEMORY = 1 << 20


def merged(limits: dict | None) -> dict:
    """The default limits with those that are given."""
    return {k: v[0] for k, v in K.LIMITS.items()} | (limits or {})


def limits(found: dict) -> None:
    """All limits, each above zero and within the absolute ceilings."""
    if set(found) != set(K.LIMITS) or any(not 0 < v <= K.LIMITS[k][1] for k, v in found.items()) or found["max_memory_bytes"] < _LEAST_MEMORY:
        raise FormatError("ResourceLimit", "limits")


def patch_capacity(have: int, more: int, limits: dict | None = None) -> int:
    """Patches after so many more, if the limits have room for them and for their modelled memory."""
    most, total = merged(limits), have + more
    if not more or total > most["max_patches"] or total * PATCH_BYTES > most["max_memory_bytes"]:
        raise FormatError("ResourceLimit", "patches")
    return total


def _rising(values: list, code: str) -> None:
    if any(b <= a for a, b in zip(values, values[1:])):
        raise FormatError("NonCanonical", code)


def _voxels(count: int, most: dict) -> None:
    if count > most["max_voxels"]:
        raise FormatError("ResourceLimit", "voxels")


def terrain(ids: list[int], limits: dict | None = None) -> None:
    """Deleted cells in canonical order, inside the grid."""
    x, y, z = K.TERRAIN_GRID
    _voxels(len(ids), merged(limits))
    if any(not 0 <= i < x * y * z for i in ids):
        raise FormatError("OutOfBounds", "terrain-coordinate")
    _rising(ids, "terrain-order")


def building(size: tuple, voxels: list[tuple[int, int]], limits: dict | None = None) -> None:
    """(id, material) in canonical order: inside the scene, of a material, and not of too many."""
    most = merged(limits)
    _voxels(len(voxels), most)
    if any(not 1 <= s <= 512 for s in size):
        raise FormatError("OutOfBounds", "building-dimensions")
    if any(not 0 <= i < size[0] * size[1] * size[2] or not 0 < m <= 0xFFFF for i, m in voxels):
        raise FormatError("OutOfBounds", "building-voxel")
    _rising([i for i, _ in voxels], "building-order")
    if len({m for _, m in voxels}) > most["max_materials"]:
        raise FormatError("ResourceLimit", "materials")


def _quads(quads: list[tuple], sizes: tuple | int, resource: bool) -> None:
    """(axis, side, [resource], plane, u0, u1, v0, v1, colour), in order and on the grid."""
    for axis, side, *rest in quads:
        kind, (plane, u0, u1, v0, v1, colour) = (rest[0], rest[1:]) if resource else (0, rest)
        if axis > 2 or side > 1 or kind >= len(K.RESOURCE_COLOURS) or colour > 0xFFF:
            raise FormatError("OutOfBounds", "quad")
        grid = (sizes,) * 3 if isinstance(sizes, int) else sizes
        along, across = (grid[k] for k in P.TANGENTS[axis])
        if plane > grid[axis] or not u0 < u1 <= along or not v0 < v1 <= across:
            raise FormatError("OutOfBounds", "quad")
    _rising(quads, "quad-order")


def forged(item: Forged, limits: dict | None = None) -> None:
    """Equipment, and either one to 31 components or an appearance."""
    if any(a > 63 for a in item.attributes):
        raise FormatError("OutOfBounds", "attributes")
    if item.appearance is not None:
        dims, _, quads = item.appearance
        if any(d % 2 or not 2 <= d <= 1022 for d in dims) or not 1 <= len(quads) <= 4095:
            raise FormatError("OutOfBounds", "appearance")
        _quads(quads, 24, True)
        _voxels(len(quads), merged(limits))
        return
    if not 1 <= len(item.components) <= 31:
        raise FormatError("OutOfBounds", "components")
    for c in item.components:
        if c.resource >= len(K.RESOURCE_COLOURS) or c.colour > 0xFFF or 0 in c.dims or not c.cells:
            raise FormatError("OutOfBounds", "component")
        _rising(c.cells, "cells-order")
        if c.cells[0] < 0 or c.cells[-1] >= CELLS:
            raise FormatError("NonCanonical", "cells-order")
        _quads(c.paint, K.FORGE_GRID, False)
        if c.grip is not None and (c.grip[1] > 2 or c.grip[2] not in (-1, 1) or c.grip[3] > 3):
            raise FormatError("OutOfBounds", "grip")
    _voxels(sum(len(c.cells) for c in item.components), merged(limits))
