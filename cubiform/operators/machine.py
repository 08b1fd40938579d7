"""Whole programs: scenes that only draw as one plan, scenes that also move or erase cells in order, one by one.

A command that copies or clears reads the scene as the commands before it left it, so such a scene is
sequential; it is bounded by the limits, and scenes are independent. Errors are rows of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import cubiform

from .. import constants as K
from ..sources import batches as B
from ..sources import programs as P
from ..sources.assets import MOVES, dicts, listed_op, program_of
from ..sources.wire import FormatError
from . import difference, geometry, state

cloudpickle.register_pickle_by_value(cubiform)

#: Commands that read what is there.
SEQUENTIAL = (*MOVES, "cut", "clear_box")


def _parts(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands of the scenes that only draw, and those of the others; both dealt by scene."""
    known = commands.filter(F.col("op").isNotNull()) if "error_kind" in commands.columns else commands
    dealt = known.repartition(geometry.tasks(commands.sparkSession), "scene").withColumn("_moves", F.max(F.col("op").isin(*SEQUENTIAL)).over(Window.partitionBy("scene")))
    return dealt.filter("not _moves").drop("_moves"), dealt.filter("_moves").drop("_moves")


def _limits(limits: dict | None) -> dict:
    return {k: v[0] for k, v in K.LIMITS.items()} | (limits or {})


def _box_errors(box_rows: DataFrame, dims: tuple, most: dict) -> DataFrame:
    """Box rows with error, the first of their scene in the order of commands, or null."""
    scene, command = Window.partitionBy("scene"), Window.partitionBy("scene", "seq")
    sized = geometry.volume(box_rows).withColumn("_charge", F.sum(F.greatest("cells", F.lit(0))).over(command)).withColumn("_inside", F.min(geometry.within(box_rows, dims)).over(command))
    sized = sized.withColumn("_used", F.sum(F.greatest("cells", F.lit(0))).over(scene.orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    sized = sized.withColumn("_at", F.dense_rank().over(scene.orderBy("seq")))
    of = lambda kind, code: F.struct("seq", F.lit(kind).alias("kind"), F.lit(code).alias("code"))
    wrong = F.when(F.col("_charge") > most["max_op_expansion"], of("ResourceLimit", "expansion")).when(~F.col("_inside"), of("OutOfBounds", "box")).when(F.col("_used") > most["max_writes"], of("ResourceLimit", "writes"))
    many = F.when(F.max("_at").over(scene) > most["max_commands"], F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("ResourceLimit").alias("kind"), F.lit("commands").alias("code")))
    return sized.withColumn("error", F.coalesce(many, F.min(wrong).over(scene))).drop("_charge", "_inside", "_used", "_at", "cells")


def _interpreted(commands: DataFrame, dims: tuple, limits: dict | None) -> DataFrame:
    """(scene, cells, kind, code) of scenes that are run command by command."""
    named = [n for n in dims if isinstance(n, str)]
    gathered = commands.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("seq", *(c for c in commands.columns if c not in ("scene", "seq", *named))))).alias("ops"), *(F.first(n).alias(n) for n in named))
    fixed = None if named else tuple(dims)
    kind = commands.schema["scene"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids, materials, kinds, codes = [0], [], [], [], []
            sizes = zip(*(batch.column(n).to_pylist() for n in named)) if named else itertools.repeat(fixed)
            for ops, size in zip(dicts(batch.column("ops")), sizes):
                try:
                    scene = P.execute(P.Program(size, [listed_op(op) for op in ops]), limits)
                    ids += scene.voxels
                    materials += scene.voxels.values()
                    kinds.append(None)
                    codes.append(None)
                except FormatError as e:
                    kinds.append(e.kind)
                    codes.append(e.code)
                ends.append(len(ids))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(materials, pa.int64())], ["id", "material"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), made, pa.array(kinds, pa.string()), pa.array(codes, pa.string())], ["scene", "cells", "kind", "code"])

    return gathered.mapInArrow(run, f"scene {kind}, cells array<struct<id:long,material:long>>, kind string, code string")


def run(commands: DataFrame, dims: tuple, limits: dict | None = None, patches: DataFrame | None = None) -> DataFrame:
    """(scene, id, material) of whole programs, with their patches if given; scenes with an error give none.

    dims: the sizes of all scenes, or the names of the columns that hold them. See faults for the errors.
    """
    most = _limits(limits)
    drawn, moving = _parts(commands)
    keep = tuple(n for n in dims if isinstance(n, str))
    fine = _box_errors(geometry.boxes(drawn, keep=keep), dims, most).filter("error is null").drop("error")
    plain = state.last_writer(geometry.cells(fine, dims, most["max_op_expansion"]))
    plain = plain.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("scene"))).filter(F.col("_n") <= most["max_voxels"]).drop("_n")
    rest = _interpreted(moving, dims, limits).filter("kind is null").select("scene", F.inline("cells"))
    cells = plain.unionByName(rest)
    return cells if patches is None else difference.apply_patches(cells, patches)


def building_roots(assets: DataFrame) -> DataFrame:
    """(scene, voxels, root) of what the commands of building assets, (asset, content), draw; bad ones and empty scenes give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch: dict = {}
        for batch in batches:
            counts, roots, odd = B.rooted(batch.column(1), scratch)
            for i in np.flatnonzero(odd).tolist():
                try:
                    program = program_of(batch.column(1)[i].as_py() or b"")
                    scene = P.execute(P.Program(program.size, program.ops))
                    counts[i], roots[i] = len(scene.voxels), scene.root()
                except FormatError:
                    pass
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(roots, pa.string())], ["scene", "voxels", "root"])
            yield made.filter(pc.greater(made.column("voxels"), 0))

    return assets.select("asset", "content").mapInArrow(run, "scene string, voxels long, root string")


def faults(commands: DataFrame, dims: tuple, limits: dict | None = None) -> DataFrame:
    """(scene, kind, code): the first error of each scene that has one; unreadable assets included.

    Of a scene that only draws, and goes beyond its writes and its voxels as well, the writes are named.
    """
    most = _limits(limits)
    drawn, moving = _parts(commands)
    keep = tuple(n for n in dims if isinstance(n, str))
    checked = _box_errors(geometry.boxes(drawn, keep=keep), dims, most)
    early = checked.filter("error is not null").select("scene", "error.kind", "error.code").distinct()
    cells = state.last_writer(geometry.cells(checked.filter("error is null").drop("error"), dims, most["max_op_expansion"]))
    full = cells.groupBy("scene").count().filter(F.col("count") > most["max_voxels"]).select("scene", F.lit("ResourceLimit").alias("kind"), F.lit("voxels").alias("code"))
    found = early.unionByName(full).unionByName(_interpreted(moving, dims, limits).filter("kind is not null").select("scene", "kind", "code"))
    if "error_kind" in commands.columns:
        found = found.unionByName(commands.filter("error_kind is not null").select("scene", F.col("error_kind").alias("kind"), F.col("error_code").alias("code")).distinct())
    return found
