"""Commands to cells: every drawing command becomes boxes, every box becomes cells.

commands: scene, seq, op, material and the arguments an op needs. A command's boxes are written in
the order of sub, later ones over earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import cubiform

from .. import constants as K

cloudpickle.register_pickle_by_value(cubiform)

#: Boxes of one command; fewer sub-writes than this, so that order = seq * SUBS + sub is one long.
SUBS = 1 << 20
_BOX = "struct<sub:bigint,material:bigint,x:bigint,y:bigint,z:bigint,w:bigint,h:bigint,d:bigint>"


def tasks(spark: SparkSession) -> int:
    """Partitions of work in Python: several a core, so that uneven scenes even out and a batch stays small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def _box(sub, material, x, y, z, w, h, d) -> Column:
    names = "sub material x y z w h d".split()
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n) for n, v in zip(names, (sub, material, x, y, z, w, h, d))))


def _c(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def box() -> Column:
    m, *rest = _c("material", "ox", "oy", "oz", "sx", "sy", "sz")
    return F.array(_box(0, m, *rest))


def run() -> Column:
    """length cells along axis."""
    m, x, y, z, axis, n = _c("material", "ox", "oy", "oz", "axis", "length")
    return F.array(_box(0, m, x, y, z, *(F.when(axis == k, n).otherwise(1) for k in range(3))))


def _oriented(axis: Column, along: Column, u: Column, v: Column) -> list[Column]:
    """Sizes by x, y, z of a piece with along on the axis and u, v on its tangents."""
    return [F.when(axis == 0, along).otherwise(u), F.when(axis == 1, along).when(axis == 0, u).otherwise(v), F.when(axis == 2, along).otherwise(v)]


def wall() -> Column:
    m, x, y, z, axis, u, v, t = _c("material", "ox", "oy", "oz", "axis", "u", "v", "thickness")
    return F.array(_box(0, m, x, y, z, *_oriented(axis, t, u, v)))


def extrude() -> Column:
    """Each set cell u + u_length * v of the mask, an array of 0 and 1, times depth along the axis."""
    m, x, y, z, axis, u, depth, mask = _c("material", "ox", "oy", "oz", "axis", "u", "depth", "mask")
    zero = F.lit(0)

    def one(i: Column) -> Column:
        at = _oriented(axis, zero, i % u, F.floor(i / u))
        return _box(i, m, x + at[0], y + at[1], z + at[2], *_oriented(axis, depth, F.lit(1), F.lit(1)))

    return F.transform(F.filter(_upto(F.size(mask)), lambda i: F.element_at(mask, (i + 1).cast("int")) == 1), one)


def repeat_box() -> Column:
    m, x, y, z, w, h, d, n, dx, dy, dz = _c("material", "ox", "oy", "oz", "sx", "sy", "sz", "count", "dx", "dy", "dz")
    return F.transform(_upto(n), lambda i: _box(i, m, x + dx * i, y + dy * i, z + dz * i, w, h, d))


def gable(style: str, z_oriented: bool) -> Column:
    """Layer k is drawn k higher and k further in from both ends of the span."""
    m, x, y, z, w, d = _c("material", "ox", "oy", "oz", "width", "depth")
    span, across = (d, w) if z_oriented else (w, d)
    layers = F.floor((span + 1) / 2)

    def place(k: Column, sub, along: Column, side: Column, n_along, n_side) -> Column:
        """along counts from the span's beginning, side across it."""
        if z_oriented:
            return _box(k * 4 + sub, m, x + side, y + k, z + along, n_side, 1, n_along)
        return _box(k * 4 + sub, m, x + along, y + k, z + side, n_along, 1, n_side)

    def one(k: Column) -> Column:
        near, far, zero = k, span - 1 - k, F.lit(0)
        if style == "fill":
            return F.array(place(k, 0, near, zero, span - 2 * k, across))
        if style == "outline":
            both = [place(k, 0, near, zero, 1, across), place(k, 1, far, zero, 1, across)]
        else:
            both = [place(k, 2 * i + j, at, side, 1, 1) for i, at in enumerate((near, far)) for j, side in enumerate((zero, across - 1))]
        half = len(both) // 2
        return F.when(near == far, F.array(*both[:half])).otherwise(F.array(*both))

    return F.flatten(F.transform(_upto(layers), one))


def tree() -> Column:
    """A trunk of two by two, two crossing bars of leaves a layer, and a top."""
    trunk, leaf, x, y, z, height, crown = _c("material", "material2", "ox", "oy", "oz", "height", "crown")
    stem = F.greatest(height - crown, F.lit(2))

    def layer(k: Column) -> Column:
        r = F.greatest(crown - F.floor(k / 2), F.lit(1))
        up = y + stem - 1 + k
        return F.array(_box(1 + 2 * k, leaf, x - r, up, z - 1, 2 * r + 2, 1, 4), _box(2 + 2 * k, leaf, x - 1, up, z - r, 4, 1, 2 * r + 2))

    return F.concat(F.array(_box(0, trunk, x, y, z, 2, stem, 2)), F.flatten(F.transform(_upto(crown), layer)), F.array(_box(2 * crown + 1, leaf, x, y + height - 1, z, 2, 1, 2)))


def fence() -> Column:
    """Rails one and three up, posts of five every spacing and at the end."""
    m, x, y, z, axis, n, spacing = _c("material", "ox", "oy", "oz", "axis", "length", "spacing")
    along = lambda i: (F.when(axis == 0, i).otherwise(0), F.when(axis == 1, i).otherwise(0))
    rail = [F.when(axis == 0, n).otherwise(1), F.lit(1), F.when(axis == 1, n).otherwise(1)]
    rails = [_box(k, m, x, y + up, z, *rail) for k, up in enumerate((1, 3))]
    post = lambda sub, i: _box(sub, m, x + along(i)[0], y, z + along(i)[1], 1, 5, 1)
    posts = F.transform(_upto(F.floor((n + spacing - 1) / spacing)), lambda k: post(k + 2, k * spacing))
    return F.concat(F.array(*rails), posts, F.array(post(F.lit(SUBS - 1), n - 1)))


DRAWN = {"box": box, "cut": box, "clear_box": box, "run": run, "wall": wall, "extrude": extrude, "repeat_box": repeat_box, "tree": tree, "fence": fence}
DRAWN |= {f"gable_{s}_{'z' if o else 'x'}": (lambda s=s, o=o: gable(s, o)) for s in ("outline", "trim", "fill") for o in (False, True)}


#: What an op needs besides a material, an origin and a size.
_NEEDS = {"run": {"length"}, "wall": {"u", "thickness"}, "extrude": {"mask"}, "repeat_box": {"count"}, "tree": {"crown"}, "fence": {"spacing"}} | {k: {"width"} for k in DRAWN if k.startswith("gable")}


def boxes(commands: DataFrame, op: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scene, seq, keep, sub, material, x, y, z, w, h, d): the boxes of commands, all of one op or by their op.

    An op that draws no boxes, or one whose arguments the table hasn't, is an error: what moves cells
    belongs to machine.run.
    """
    if op is None:
        have = set(commands.columns)
        cases = F.when(F.col("op").isNull(), F.array().cast(f"array<{_BOX}>"))
        for k, made in DRAWN.items():
            if _NEEDS.get(k, set()) <= have:
                cases = cases.when(F.col("op") == k, made().cast(f"array<{_BOX}>"))
        cases = cases.otherwise(F.raise_error(F.concat(F.lit("no boxes for the op "), F.col("op"))))
    else:
        cases = DRAWN[op]()
    return commands.select("scene", "seq", *keep, F.inline(cases))


def volume(box_rows: DataFrame) -> DataFrame:
    """Cells of each box, known before any is made."""
    return box_rows.withColumn("cells", F.col("w") * F.col("h") * F.col("d"))


def sizes(dims: tuple) -> list[Column]:
    """The scene's sizes as columns: numbers, or names of columns."""
    return [F.col(n) if isinstance(n, str) else F.lit(n) for n in dims]


def within(box_rows: DataFrame, dims: tuple) -> Column:
    """Whether a box is not empty and lies inside the scene."""
    ok = F.lit(True)
    for at, size, most in zip("xyz", "whd", sizes(dims)):
        ok &= (F.col(at) >= 0) & (F.col(size) > 0) & (F.col(at) + F.col(size) <= most)
    return ok


def box_faults(box_rows: DataFrame, dims: tuple, max_cells: int = K.LIMITS["max_op_expansion"][1]) -> DataFrame:
    """(scene, seq, kind, code): commands with a box that is empty or leaves the scene, or with too many cells."""
    each = volume(box_rows).groupBy("scene", "seq").agg(F.bool_and(within(box_rows, dims)).alias("inside"), F.sum(F.greatest("cells", F.lit(0))).alias("cells"))
    wrong = F.when(F.col("cells") > max_cells, F.struct(F.lit("ResourceLimit").alias("kind"), F.lit("expansion").alias("code"))).when(~F.col("inside"), F.struct(F.lit("OutOfBounds").alias("kind"), F.lit("box").alias("code")))
    return each.withColumn("wrong", wrong).filter("wrong is not null").select("scene", "seq", "wrong.kind", "wrong.code")


def cells(box_rows: DataFrame, dims: tuple, max_cells: int = K.LIMITS["max_op_expansion"][1]) -> DataFrame:
    """(scene, ord, id, material) of every write; a box above max_cells, an empty one or one outside is an error.

    Use box_faults, or machine.run, where such boxes shall be rows. Rows are dealt by scene before they
    multiply, so what is shuffled is commands and not cells, and whatever is then grouped by scene and
    id needs no further exchange.
    """
    sx, _, sz = sizes(dims)
    fine = within(box_rows, dims) & (F.col("cells") <= max_cells)
    count = F.when(fine, F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("a box of scene "), F.col("scene").cast("string"), F.lit(" is empty, leaves the scene or is above the limit"))).cast("long"))
    each = volume(box_rows).select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"))
    x = F.col("x") + F.col("i") % F.col("w")
    z = F.col("z") + F.floor(F.col("i") / F.col("w")) % F.col("d")
    y = F.col("y") + F.floor(F.col("i") / (F.col("w") * F.col("d")))
    return each.select("scene", (F.col("seq") * SUBS + F.col("sub")).alias("ord"), (x + sx * (z + sz * y)).alias("id"), "material")


def draw(commands: DataFrame, dims: tuple, op: str | None = None) -> DataFrame:
    """Cells of all commands, dealt by scene."""
    keep = tuple(n for n in dims if isinstance(n, str))
    return cells(boxes(commands.repartition("scene"), op, keep), dims)


#: Cells that are made at once; a scene with more is made alone.
_CHUNK = 1 << 20


def _last_cells(boxes: list[np.ndarray], dims: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scene, id, material) of the last writes of boxes (scene, order, material, x, y, z, w, h, d)."""
    order = np.lexsort((boxes[1], boxes[0]))
    scene, _, material, x, y, z, w, h, d = (c[order] for c in boxes)
    cells = w * h * d
    at = np.repeat(np.arange(len(cells)), cells)
    i = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    row, w = i // w[at], w[at]
    corner, deep = (x + dims[0] * (z + dims[2] * y))[at], d[at]
    place = corner + (i - row * w) + dims[0] * (row % deep + dims[2] * (row // deep))
    key = scene[at] * (dims[0] * dims[1] * dims[2]) + place
    sort = np.argsort(key, kind="stable")
    key = key[sort]
    last = sort[np.append(key[1:] != key[:-1], True)] if len(key) else sort
    last = last[material[at[last]] != 0]
    return scene[at[last]], place[last], material[at[last]]


def voxels(commands: DataFrame, dims: tuple[int, int, int], op: str | None = None, max_cells: int = K.LIMITS["max_op_expansion"][1]) -> DataFrame:
    """(scene, id, material): what state.last_writer makes of draw, with the cells made in numpy.

    Only boxes and the cells that stay pass between Spark and Python; errors are those of cells.
    """
    each = boxes(commands.repartition(tasks(commands.sparkSession), "scene"), op)
    fine = within(each, dims) & (F.col("w") * F.col("h") * F.col("d") <= max_cells)
    width = F.when(fine, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("a box of scene "), F.col("scene").cast("string"), F.lit(" is empty, leaves the scene or is above the limit"))).cast("long"))
    names = ["ord", "material", "x", "y", "z", "w", "h", "d"]
    listed = each.select("scene", (F.col("seq") * SUBS + F.col("sub")).alias("ord"), "material", "x", "y", "z", width.alias("w"), "h", "d")
    gathered = listed.groupBy("scene").agg(F.collect_list(F.struct(*names)).alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy()
            flat = [c.to_numpy() for c in batch.column(1).flatten().flatten()]
            flat.insert(0, np.repeat(np.arange(len(counts)), counts))
            ends = np.cumsum(counts)
            made = np.cumsum(flat[6] * flat[7] * flat[8])[ends - 1]
            start = 0
            while start < len(counts):
                have = made[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(made, have + _CHUNK, "right")))
                scene, place, material = _last_cells([c[ends[start] - counts[start] : ends[stop - 1]] for c in flat], dims)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(scene)), pa.array(place), pa.array(material)], ["scene", "id", "material"])
                start = stop

    return gathered.mapInArrow(run, f"scene {commands.schema['scene'].dataType.simpleString()}, id long, material long")
