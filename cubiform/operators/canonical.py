"""Canonical bytes of scenes, their hashes, and accounting of encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def gaps(rows: DataFrame, key: str = "scene", value: str = "id") -> DataFrame:
    """Adds gap: the first value as it is, then each minus the one before minus 1."""
    w = Window.partitionBy(key).orderBy(value)
    return rows.withColumn("gap", F.coalesce(F.col(value) - F.lag(value).over(w) - 1, F.col(value)))


def _joined(key: str, value: str, text: Column) -> Column:
    """The texts of a group's rows in order of value; a group is a bounded scene."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), text.alias("t")))), lambda s: s["t"]), "")


def building_roots(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(scene, voxels, root) of building scenes."""
    head = F.concat(*(S.varint_hex(F.lit(d)) for d in dims))
    each = gaps(voxels).withColumn("t", F.concat(S.varint_hex("gap"), S.varint_hex("material")))
    found = each.groupBy("scene").agg(F.count(F.lit(1)).alias("voxels"), _joined("scene", "id", F.col("t")).alias("body"))
    return found.select("scene", "voxels", S.semantic_root("building", F.concat(head, S.varint_hex("voxels"), F.col("body"))).alias("root"))


def terrain_roots(cells: DataFrame) -> DataFrame:
    """(scene, deletions, root) from (scene, id, min_y)."""
    each = gaps(cells.select("scene", "id", "min_y").distinct()).withColumn("t", S.varint_hex("gap"))
    found = each.groupBy("scene", "min_y").agg(F.count(F.lit(1)).alias("deletions"), _joined("scene", "id", F.col("t")).alias("body"))
    return found.select("scene", "deletions", S.semantic_root("terrain_delta", F.concat(S.varint_hex(S.zigzag("min_y")), S.varint_hex("deletions"), F.col("body"))).alias("root"))


def forge_cell_hex(cells: DataFrame) -> DataFrame:
    """(component, cells, body): the canonical count and gaps of each component's cells, as hex."""
    each = gaps(cells.select("component", "cell").distinct(), "component", "cell").withColumn("t", S.varint_hex("gap"))
    found = each.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), _joined("component", "cell", F.col("t")).alias("body"))
    return found.select("component", "cells", F.concat(S.varint_hex("cells"), F.col("body")).alias("body"))


def widths(dims: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    """Bits of a coordinate on each axis."""
    x, y, z = (S.bits_needed(F.lit(d - 1)) for d in dims)
    return x, y, z


def command_bits(op: Column, dims: tuple[int, int, int], materials: Column, axis: Column, mask_bits: Column) -> Column:
    """Bits of a compact command, by op."""
    cx, cy, cz = widths(dims)
    m, c = S.bits_needed(F.greatest(materials - 1, F.lit(0))), cx + cy + cz
    along = F.when(axis == 0, cx).when(axis == 1, cy).otherwise(cz)
    flat = F.when(axis == 0, cx).otherwise(cz)
    sizes = {
        "box": 4 + m + 2 * c, "repeat_box": 4 + m + 2 * c + 39, "gable": 4 + m + 3 + c + cx + cz, "tree": 4 + 2 * m + c + 10, "fence": 4 + m + c + 1 + flat + 6,
        "run": 4 + m + c + 2 + along, "wall": 4 + m + c + 2 + c, "extrude": 4 + m + c + 2 + c + mask_bits, "translate": 4 + 2 * c + 30,
        "rotate_y": 4 + 3 * c + 2, "mirror": 4 + 3 * c + 2, "repeat_region": 4 + 2 * c + 39, "clear_box": 4 + 2 * c,
    }
    found = F.lit(None).cast("int")
    for name, bits in sizes.items():
        found = F.when(op == name, bits).otherwise(found)
    return found.cast("long")


def profile_header_bytes(dims: tuple[int, int, int], palette: Column, commands: Column) -> Column:
    """Dimensions, palette and command count, as integers of seven bits a byte; palette is an array."""
    head = sum((S.varint_length(F.lit(d)) for d in dims), F.lit(0))
    listed = F.aggregate(F.transform(palette, S.varint_length), F.lit(0), lambda a, x: a + x)
    return (head + S.varint_length(F.size(palette)) + listed + S.varint_length(commands)).cast("long")


def audited(sizes: DataFrame) -> DataFrame:
    """From (scene, source_bytes, compact_bytes): what is saved, which form is chosen, whether to search on.

    A compact form is chosen only when it is strictly smaller; a search is worth it up to 16 bytes above.
    """
    smaller = F.col("compact_bytes") < F.col("source_bytes")
    return sizes.select(
        "*", (F.col("source_bytes") - F.col("compact_bytes")).alias("saved_bytes"), S.saved_bps("source_bytes", "compact_bytes").alias("saved_bps"),
        F.when(smaller, "compact").otherwise("source").alias("selected"), (smaller | (F.col("compact_bytes") <= F.col("source_bytes") + 16)).alias("deep_search"),
    )
