"""Painted rectangles on forged components: overlaps, bare cells and internal faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACE = ["owner", "axis", "side", "plane"]


def overlaps(quads: DataFrame) -> DataFrame:
    """(owner, first, second): pairs on one face that share area.

    Faces make it an equi-join; along u, quads meet in every unit column they span, and a pair counts
    in the first column they share, so the work follows the overlaps rather than all pairs of a face.
    """
    columns = quads.select(*FACE, "quad", "u0", "u1", "v0", "v1", F.explode(F.sequence("u0", F.col("u1") - 1)).alias("u"))
    other = columns.select(*FACE, "u", *(F.col(c).alias(f"{c}_b") for c in ("quad", "u0", "u1", "v0", "v1")))
    met = columns.join(other, [*FACE, "u"]).filter("quad < quad_b and v0 < v1_b and v0_b < v1 and u = greatest(u0, u0_b)")
    return met.select("owner", F.col("quad").alias("first"), F.col("quad_b").alias("second"))


def bare_cells(quads: DataFrame, cells: DataFrame) -> DataFrame:
    """(owner, quad, bare): cells under a quad on a z plane that its component doesn't have."""
    each = quads.select("owner", "quad", "plane", F.explode(F.sequence("u0", F.col("u1") - 1)).alias("u"), "v0", "v1")
    each = each.select("owner", "quad", F.explode(F.sequence("v0", F.col("v1") - 1)).alias("v"), "u", "plane")
    under = each.select("owner", "quad", (F.col("u") + 14 * (F.col("v") + 10 * F.col("plane"))).alias("cell"))
    have = cells.select(F.col("component").alias("owner"), "cell").distinct()
    return under.join(have, ["owner", "cell"], "left_anti").groupBy("owner", "quad").agg(F.count(F.lit(1)).alias("bare"))


def faults(quads: DataFrame, cells: DataFrame) -> DataFrame:
    """(owner, quad, bare, internal): quads on any axis that don't lie on their component's surface.

    bare counts cells under a quad that its component doesn't have, places outside the grid included;
    internal those it has whose neighbour across the face it has too. The cell under a quad is at the
    plane, or one below it for side 1; u and v run along the other two axes in order.
    """
    each = quads.select("owner", "quad", "axis", "side", "plane", F.explode(F.sequence("u0", F.col("u1") - 1)).alias("u"), "v0", "v1")
    each = each.select("owner", "quad", "axis", "side", "plane", "u", F.explode(F.sequence("v0", F.col("v1") - 1)).alias("v"))

    def at(along: Column) -> Column:
        x, y, z = F.when(F.col("axis") == 0, along).otherwise(F.col("u")), F.when(F.col("axis") == 1, along).otherwise(F.when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v"))), F.when(F.col("axis") == 2, along).otherwise(F.col("v"))
        # No component has cells outside the grid; ids must not wrap around to others.
        inside = x.between(0, 13) & y.between(0, 9) & z.between(0, 13)
        return F.when(inside, x + 14 * (y + 10 * z))

    under, across = F.col("plane") - F.col("side"), F.col("plane") - 1 + F.col("side")
    each = each.select("owner", "quad", at(under).alias("under"), at(across).alias("across"))
    have = cells.select(F.col("component").alias("owner"), "cell").distinct()
    each = each.join(have.select("owner", F.col("cell").alias("under"), F.lit(True).alias("held")), ["owner", "under"], "left")
    each = each.join(have.select("owner", F.col("cell").alias("across"), F.lit(True).alias("hidden")), ["owner", "across"], "left")
    found = each.groupBy("owner", "quad").agg(F.count_if(F.col("held").isNull()).alias("bare"), F.count_if(F.col("held") & F.col("hidden")).alias("internal"))
    return found.filter("bare > 0 or internal > 0")
