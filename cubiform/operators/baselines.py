"""Deterministic candidate generators: runs, layers, bounding boxes, slices, greedy covers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import cubiform

from .. import constants as K
from ..functions.scalars import bits_needed, split_id, varint_length, zigzag
from ..sources.programs import TANGENTS
from .compress import grown_boxes
from .difference import islands

cloudpickle.register_pickle_by_value(cubiform)


def terrain_runs(cells: DataFrame, least: int) -> DataFrame:
    """(scene, start, length) of runs of at least so many deleted cells."""
    return islands(cells.select("scene", "id").distinct(), ["scene"]).filter(F.col("length") >= least)


def terrain_layers(cells: DataFrame, least: int) -> DataFrame:
    """(scene, y, bits) of layers with at least so many deleted cells."""
    layer = cells.select("scene", "id").distinct().withColumn("y", F.floor(F.col("id") / 256))
    return layer.groupBy("scene", "y").agg(F.count(F.lit(1)).alias("bits")).filter(F.col("bits") >= least)


def terrain_bytes(cells: DataFrame) -> DataFrame:
    """(scene, sparse, split, runs, layers, best, bytes): stored bytes of a terrain's four exact programs, from (scene, id, min_y).

    One window over the distinct cells, and one aggregation, on the scene alone.
    """
    w = Window.partitionBy("scene").orderBy("id")
    before = F.lag("id").over(w)
    steps = cells.select("scene", "id", "min_y").distinct().withColumn("gap", F.coalesce(F.col("id") - before - 1, F.col("id")))
    steps = steps.withColumn("from", F.coalesce(before != F.col("id") - 1, F.lit(True))).withColumn("to", F.coalesce(F.lead("id").over(w) != F.col("id") + 1, F.lit(True)))
    y = F.floor(F.col("id") / 256)
    steps = steps.withColumn("place", F.row_number().over(w)).withColumn("layer", F.coalesce(F.floor(before / 256) != y, F.lit(True)))
    begun = F.max(F.when(F.col("from"), F.col("place"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.withColumn("length", F.col("place") - begun + 1)
    on = lambda flag, value: F.sum(F.when(F.col(flag), value).otherwise(0))
    found = steps.groupBy("scene").agg(
        F.first("min_y").alias("min_y"), F.count(F.lit(1)).alias("n"), F.sum(1 + varint_length("gap")).alias("gaps"), F.count_if("from").alias("k"),
        (on("from", 1 + varint_length("id")) + on("to", varint_length("length"))).alias("pieces"), F.count_if("layer").alias("l"), on("layer", varint_length(y)).alias("heights"),
    )
    universe = K.TERRAIN_GRID[0] * K.TERRAIN_GRID[1] * K.TERRAIN_GRID[2]
    head = 8 + varint_length(zigzag("min_y"))
    low = bits_needed(F.floor(F.lit(universe) / F.col("n"))) - 1
    highs = F.floor(F.lit(universe - 1) / F.pow(F.lit(2), low)) + F.col("n") + 1
    sizes = {
        "sparse": head + 1 + varint_length("n") + F.col("gaps"), "split": head + 3 + varint_length("n") + 1 + F.ceil(F.col("n") * low / 8) + F.ceil(highs / 8),
        "runs": head + varint_length("k") + F.col("pieces") + 1, "layers": head + varint_length("l") + F.col("heights") + 33 * F.col("l") + 1,
    }
    found = found.select("scene", *(v.cast("long").alias(k) for k, v in sizes.items()))
    best = F.least(*(F.struct(F.col(k).alias("bytes"), F.lit(i).alias("i"), F.lit(k).alias("best")) for i, k in enumerate(sizes)))
    return found.withColumn("_best", best).select("scene", *sizes, "_best.best", "_best.bytes")


def bounds(voxels: DataFrame, keys: list[str], first: int, second: int) -> DataFrame:
    """The bounding box of each group: x0, y0, z0, x1, y1, z1 and how much of it is filled."""
    x, z, y = split_id("id", first, second)
    at = voxels.select(*keys, x.alias("x"), y.alias("y"), z.alias("z"))
    found = at.groupBy(*keys).agg(*(f(c).cast("long").alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))), F.count(F.lit(1)).alias("cells"))
    return found


def axis_runs(voxels: DataFrame, axis: int, dims: tuple[int, int, int], least: int = 2) -> DataFrame:
    """(scene, material, start, length): maximal runs along an axis, of at least two cells."""
    x, z, y = split_id("id", dims[0], dims[2])
    at = voxels.select("scene", "material", F.col("id").alias("cell"), x.alias("x"), y.alias("y"), z.alias("z"))
    along, rest = "xyz"[axis], [c for c in "xyz" if c != "xyz"[axis]]
    runs = islands(at.select("scene", "material", *rest, F.col(along).alias("id")), ["scene", "material", *rest]).filter(F.col("length") >= least)
    place = {along: F.col("start")} | {c: F.col(c) for c in rest}
    return runs.select("scene", "material", (place["x"] + dims[0] * (place["z"] + dims[2] * place["y"])).cast("long").alias("start"), "length")


def slice_extrusions(voxels: DataFrame, axis: int, dims: tuple[int, int, int]) -> DataFrame:
    """(scene, material, axis, u, v, depth, cells): what each material fills of the first slice across an axis.

    cells are the set places u + u_length * v of the mask over the two other axes, in order; the
    extrusion reaches through the whole scene, and patches mend what it writes too much.
    """
    x, z, y = split_id("id", dims[0], dims[2])
    at = {0: x, 1: y, 2: z}
    first, second = TANGENTS[axis]
    rows = voxels.filter(at[axis] == 0).select("scene", "material", (at[first] + dims[first] * at[second]).cast("long").alias("place"))
    found = rows.groupBy("scene", "material").agg(F.array_sort(F.collect_set("place")).alias("cells"))
    sizes = {"axis": axis, "u": dims[first], "v": dims[second], "depth": dims[axis]}
    return found.select("scene", "material", *(F.lit(n).cast("long").alias(c) for c, n in sizes.items()), "cells")


def greedy_boxes(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(scene, material, x, y, z, w, h, d): disjoint boxes that cover each scene, grown x, then z, then y.

    Growth is sequential inside a scene, whose size is bounded by the limits; a batch has many scenes.
    """
    sx, sy, sz = dims
    gathered = voxels.groupBy("scene").agg(F.collect_list(F.struct("id", "material")).alias("cells"))
    kind = voxels.schema["scene"].dataType.simpleString()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_id, to_xyz = (lambda x, y, z: x + sx * (z + sz * y)), (lambda i: (i % sx, i // (sx * sz), i // sx % sz))
        for batch in batches:
            places, rows = [], []
            for n, cells in enumerate(batch.column(1).to_pylist()):
                found = grown_boxes({c["id"]: c["material"] for c in cells}, (sx, sy, sz), to_id, to_xyz, (0, 2, 1))
                places += [n] * len(found)
                rows += [(m, *at, *size) for m, at, size in found]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *columns], ["scene", "material", *"xyzwhd"])

    return gathered.mapInArrow(cover, f"scene {kind}, material long, x long, y long, z long, w long, h long, d long")
