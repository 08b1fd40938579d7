"""Differences of scenes, patches, and what each residual codec would cost.

Everything here keys on the scene: once patches are dealt by scene, the windows, the sums and the
race of the codecs need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import varint_length

SET, CLEAR, PAINT = 0, 1, 2


def compared(target: DataFrame, base: DataFrame) -> DataFrame:
    """(scene, id, want, have): the full outer join on the cell, as one aggregation."""
    both = target.select("scene", "id", F.col("material").alias("want"), F.lit(None).cast("long").alias("have")).unionByName(
        base.select("scene", "id", F.lit(None).cast("long").alias("want"), F.col("material").alias("have"))
    )
    return both.groupBy("scene", "id").agg(F.max("want").alias("want"), F.max("have").alias("have"))


def mismatches(pairs: DataFrame) -> DataFrame:
    """(scene, mismatches): cells that differ."""
    return pairs.groupBy("scene").agg(F.count_if(~F.col("want").eqNullSafe(F.col("have"))).alias("mismatches"))


def patches(pairs: DataFrame) -> DataFrame:
    """(scene, id, kind, material): what turns the base into the target."""
    kind = F.when(F.col("have").isNull(), SET).when(F.col("want").isNull(), CLEAR).otherwise(PAINT)
    differ = pairs.filter(~F.col("want").eqNullSafe(F.col("have")))
    return differ.select("scene", "id", kind.alias("kind"), F.coalesce("want", F.lit(0)).alias("material"))


def palette(target: DataFrame, base: DataFrame) -> DataFrame:
    """(scene, material, index): the sorted materials of both."""
    every = target.select("scene", "material").union(base.select("scene", "material")).distinct()
    return every.withColumn("index", F.row_number().over(Window.partitionBy("scene").orderBy("material")) - 1)


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of consecutive ids with equal keys: (keys, start, length)."""
    w = Window.partitionBy(*keys).orderBy("id")
    return rows.withColumn("_island", F.col("id") - F.row_number().over(w)).groupBy(*keys, "_island").agg(F.min("id").alias("start"), F.count(F.lit(1)).alias("length")).drop("_island")


def patch_runs(rows: DataFrame) -> DataFrame:
    return islands(rows, ["scene", "kind", "material"])


def patch_boxes(rows: DataFrame, sx: int) -> DataFrame:
    """Runs that don't leave their row of x."""
    return islands(rows.withColumn("row", F.floor(F.col("id") / sx)), ["scene", "kind", "material", "row"]).drop("row")


def patch_layers(rows: DataFrame, sx: int, sz: int) -> DataFrame:
    """A bitmap for each (y, kind, material), as its sorted places."""
    layer = rows.withColumn("y", F.floor(F.col("id") / (sx * sz)))
    return layer.groupBy("scene", "y", "kind", "material").agg(F.count(F.lit(1)).alias("bits"), F.array_sort(F.collect_list(F.col("id") % (sx * sz))).alias("places"))


def patch_groups(rows: DataFrame) -> DataFrame:
    """(scene, kind, material, n, ids): all ids of a kind and material; a scene is bounded, so is a group."""
    return rows.groupBy("scene", "kind", "material").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def residual_costs(rows: DataFrame, sx: int, sy: int, sz: int) -> DataFrame:
    """From patches with their palette index: one row a scene with the bytes of each codec.

    One window in order of ids finds runs and boxes, one inside (kind, material) finds gaps, layers
    and group sizes; the sizes of all six codecs are sums in a single aggregation. xor stays null for
    scenes above its bitmap, as others do where they can't apply: here all can.
    """
    act = 1 + F.when(F.col("kind") == CLEAR, 0).otherwise(varint_length("index"))
    scene = Window.partitionBy("scene").orderBy("id")
    group = Window.partitionBy("scene", "kind", "material").orderBy("id")
    key = F.struct("kind", "material")
    before, after = F.lag("id").over(scene), F.lead("id").over(scene)
    same = lambda f: (f("id").over(scene) == F.col("id") + (1 if f is F.lead else -1)) & (f(key).over(scene) == key)
    steps = rows.select(
        "*", act.alias("act"), F.row_number().over(scene).alias("n"), F.coalesce(F.col("id") - before - 1, F.col("id")).alias("gap"),
        (~F.coalesce(same(F.lag), F.lit(False))).alias("run_from"), (~F.coalesce(same(F.lead), F.lit(False))).alias("run_to"),
    )
    steps = steps.withColumn("box_from", F.col("run_from") | (F.col("id") % sx == 0)).withColumn("box_to", F.col("run_to") | (F.col("id") % sx == sx - 1))
    so_far = scene.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = lambda flag: F.col("n") - F.max(F.when(F.col(flag), F.col("n"))).over(so_far)  # noqa: E731  places since the last beginning
    steps = steps.select("*", since("run_from").alias("run_len"), since("box_from").alias("box_len"))
    layer = F.floor(F.col("id") / (sx * sz))
    steps = steps.select(
        "*", F.coalesce(F.col("id") - F.lag("id").over(group) - 1, F.col("id")).alias("group_gap"),
        (~F.coalesce(F.floor(F.lag("id").over(group) / (sx * sz)) == layer, F.lit(False))).alias("layer_from"),
        F.lead("id").over(group).isNull().alias("group_to"), F.row_number().over(group).alias("group_n"),
    )
    x, z, y = F.col("id") % sx, F.floor(F.col("id") / sx) % sz, layer
    box_x = x - F.col("box_len")
    on = lambda flag, value: F.sum(F.when(F.col(flag), value).otherwise(0))
    count = lambda flag: F.count_if(F.col(flag))
    bitmap = -(-sx * sz // 8)
    # A run's gap and action stand where it begins, its length where it ends.
    return steps.groupBy("scene").agg(
        F.count(F.lit(1)).alias("patches"),
        (1 + varint_length(F.count(F.lit(1))) + F.sum(varint_length("gap") + F.col("act"))).cast("long").alias("sparse"),
        (1 + varint_length(count("run_from")) + on("run_from", varint_length("gap") + F.col("act")) + on("run_to", varint_length("run_len"))).cast("long").alias("runs"),
        (1 + varint_length(count("box_from")) + on("box_to", varint_length(box_x) + varint_length(y) + varint_length(z) + varint_length("box_len") + 2 + F.col("act"))).cast("long").alias("boxes"),
        (1 + varint_length(count("layer_from")) + on("layer_from", varint_length(y) + F.col("act") + bitmap)).cast("long").alias("layers"),
        (1 + -(-sx * sy * sz // 8) + F.sum("act")).cast("long").alias("xor"),
        (1 + varint_length(count("group_to")) + F.sum(varint_length("group_gap")) + on("group_to", F.col("act") + varint_length("group_n"))).cast("long").alias("groups"),
    )


def best_codec(costs: DataFrame) -> DataFrame:
    """(scene, codec, bytes): the smallest, ties to the lesser tag."""
    tags = {"sparse": 1, "runs": 2, "boxes": 3, "layers": 4, "xor": 5, "groups": 6}
    best = F.least(*(F.struct(F.col(c).alias("bytes"), F.lit(t).alias("tag"), F.lit(c).alias("codec")) for c, t in tags.items()))
    return costs.select("scene", "patches", best.alias("b")).select("scene", "patches", "b.codec", F.col("b.bytes").alias("bytes"))


def apply_patches(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state with patches applied."""
    both = state.select("scene", "id", F.col("material").alias("have"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("material")).unionByName(
        rows.select("scene", "id", F.lit(None).cast("long").alias("have"), F.col("kind").cast("int"), "material")
    )
    one = both.groupBy("scene", "id").agg(F.max("have").alias("have"), F.max("kind").alias("kind"), F.max("material").alias("material"))
    after = F.when(F.col("kind").isNull(), F.col("have")).when(F.col("kind") == CLEAR, F.lit(None)).otherwise(F.col("material"))
    return one.select("scene", "id", after.alias("material")).filter("material is not null")


def patch_violations(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Patches that would change nothing or meet the wrong state: (scene, id, kind)."""
    met = rows.join(state.select("scene", "id", F.col("material").alias("have")), ["scene", "id"], "left")
    wrong = ((F.col("kind") == SET) & F.col("have").isNotNull()) | ((F.col("kind") == CLEAR) & F.col("have").isNull())
    wrong |= (F.col("kind") == PAINT) & (F.col("have").isNull() | (F.col("have") == F.col("material")))
    return met.filter(wrong).select("scene", "id", "kind")


def prefilter_stats(pairs: DataFrame) -> DataFrame:
    """What ranks a candidate before it is evaluated: (scene, mismatches, sets, paints, runs).

    A run is a stretch of differing cells, next to each other, of one kind and material.
    """
    differ = patches(pairs)
    w = Window.partitionBy("scene").orderBy("id")
    key = F.struct("kind", "material")
    joined = (F.lag("id").over(w) == F.col("id") - 1) & (F.lag(key).over(w) == key)
    flagged = differ.withColumn("begins", ~F.coalesce(joined, F.lit(False)))
    return flagged.groupBy("scene").agg(
        F.count(F.lit(1)).alias("mismatches"), F.count_if(F.col("kind") == SET).alias("sets"), F.count_if(F.col("kind") == PAINT).alias("paints"), F.count_if("begins").alias("runs")
    )
