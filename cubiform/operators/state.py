"""The state of scenes: the last writer of a cell wins, tombstones erase, transforms copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import split_id
from .geometry import SUBS


def last_writer(writes: DataFrame) -> DataFrame:
    """(scene, id, material): the last write of each cell; material 0 erases.

    Order and material, of 16 bits, make one number, so that an aggregation keeps one long a cell.
    """
    packed = F.shiftleft(F.col("ord").cast("long"), 16) + F.col("material")
    last = writes.select("scene", "id", packed.alias("_last")).groupBy("scene", "id").agg(F.max("_last").alias("_last"))
    return last.select("scene", "id", F.col("_last").bitwiseAND(0xFFFF).alias("material")).filter("material <> 0")


def as_of(writes: DataFrame, order: Column) -> DataFrame:
    """The state before a place in the order."""
    return last_writer(writes.filter(F.col("ord") < order))


def accounting(box_rows: DataFrame) -> DataFrame:
    """(scene, commands, writes): a write counts even where it changes nothing."""
    return box_rows.groupBy("scene").agg(F.count_distinct("seq").alias("commands"), F.sum(F.col("w") * F.col("h") * F.col("d")).alias("writes"))


def clears(writes: DataFrame) -> DataFrame:
    """The same writes as tombstones."""
    return writes.withColumn("material", F.lit(0).cast("long"))


def _inside(x: Column, y: Column, z: Column) -> Column:
    span = lambda v, o, s: (v >= F.col(o)) & (v < F.col(o) + F.col(s))
    return span(x, "ox", "sx") & span(y, "oy", "sy") & span(z, "oz", "sz")


def region(state: DataFrame, commands: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Occupied cells in each command's source box, with places rx, ry, rz inside it."""
    x, z, y = split_id("id", dims[0], dims[2])
    args = [c for c in commands.columns if c not in ("scene", "material")]
    met = state.join(commands.select("scene", *args), "scene").filter(_inside(x, y, z))
    return met.select("scene", "material", *args, (x - F.col("ox")).alias("rx"), (y - F.col("oy")).alias("ry"), (z - F.col("oz")).alias("rz"))


def _copied(cells: DataFrame, dims: tuple[int, int, int], x: Column, y: Column, z: Column, sub: Column | None = None) -> DataFrame:
    order = F.col("seq") * SUBS + (F.lit(0) if sub is None else sub)
    return cells.select("scene", order.cast("long").alias("ord"), (x + dims[0] * (z + dims[2] * y)).cast("long").alias("id"), "material")


def translate(cells: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    at = [F.col(o) + F.col(r) + F.col(d) for o, r, d in (("ox", "rx", "dx"), ("oy", "ry", "dy"), ("oz", "rz", "dz"))]
    return _copied(cells, dims, *at)


def rotate_y(cells: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """turns quarter turns about the vertical, to the destination px, py, pz."""
    rx, rz, sx, sz, t = (F.col(c) for c in ("rx", "rz", "sx", "sz", "turns"))
    x = F.when(t == 1, sz - 1 - rz).when(t == 2, sx - 1 - rx).otherwise(rz)
    z = F.when(t == 1, rx).when(t == 2, sz - 1 - rz).otherwise(sx - 1 - rx)
    return _copied(cells, dims, F.col("px") + x, F.col("py") + F.col("ry"), F.col("pz") + z)


def mirror(cells: DataFrame, dims: tuple[int, int, int], pivot: bool = False) -> DataFrame:
    """Reflected on axis: about pivot_twice / 2, or inside the box and then moved to px, py, pz."""
    at = []
    for k, (o, r, s, p) in enumerate((("ox", "rx", "sx", "px"), ("oy", "ry", "sy", "py"), ("oz", "rz", "sz", "pz"))):
        if pivot:
            at.append(F.when(F.col("axis") == k, F.col("pivot_twice") - F.col(o) - F.col(r)).otherwise(F.col(o) + F.col(r)))
        else:
            at.append(F.col(p) + F.when(F.col("axis") == k, F.col(s) - 1 - F.col(r)).otherwise(F.col(r)))
    return _copied(cells, dims, *at)


def repeat_region(cells: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Copies 1 .. count - 1 of a snapshot, each delta further; later copies win."""
    each = cells.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long") - 1)))
    at = [F.col(o) + F.col(r) + F.col(d) * F.col("copy") for o, r, d in (("ox", "rx", "dx"), ("oy", "ry", "dy"), ("oz", "rz", "dz"))]
    return _copied(each, dims, *at, sub=F.col("copy"))


def cut_boxes(cells: DataFrame, boxes: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """Cells, (component, cell), without those inside a box, (component, ox, oy, oz, sx, sy, sz), of their component."""
    rows = cells.select("component", "cell").distinct()
    x, y, z = split_id("cell", grid[0], grid[1])
    inside = rows.join(boxes.select("component", "ox", "oy", "oz", "sx", "sy", "sz"), "component").filter(_inside(x, y, z)).select("component", "cell")
    return rows.join(inside.distinct(), ["component", "cell"], "left_anti")


def symmetry(cells: DataFrame, axis: int, grid: tuple[int, int, int]) -> DataFrame:
    """Cells, (component, cell), and their images on the other side of the middle across an axis."""
    step = (1, grid[0], grid[0] * grid[1])[axis]
    at = split_id("cell", grid[0], grid[1])[axis]
    image = F.col("cell") + step * (grid[axis] - 1 - 2 * at)
    return cells.select("component", F.explode(F.array(F.col("cell").cast("long"), image.cast("long"))).alias("cell")).distinct()


TRANSFORMS = {"translate": translate, "rotate_y": rotate_y, "mirror": mirror, "repeat_region": repeat_region}


def transformed(state: DataFrame, commands: DataFrame, op: str, dims: tuple[int, int, int], **how) -> DataFrame:
    """The state after one transform a scene: what it writes goes over what was there."""
    made = {"translate": translate, "rotate_y": rotate_y, "mirror": mirror, "repeat_region": repeat_region}[op](region(state, commands, dims), dims, **how)
    before = state.select("scene", F.lit(-1).cast("long").alias("ord"), "id", "material")
    return last_writer(before.unionByName(made))
