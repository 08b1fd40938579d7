"""Verification: is a candidate exact, and strictly smaller?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(sizes: DataFrame, mismatches: DataFrame) -> DataFrame:
    """From audited sizes and mismatch counts: one report a scene."""
    wrong = F.coalesce("mismatches", F.lit(0))
    exact, improved = wrong == 0, F.col("compact_bytes") < F.col("source_bytes")
    return sizes.join(mismatches, "scene", "left").select(
        "scene", exact.alias("exact"), improved.alias("improved"), (exact & improved).alias("accepted"), wrong.alias("mismatches"), "saved_bytes", "saved_bps"
    )


def same_roots(target: DataFrame, candidate: DataFrame) -> DataFrame:
    """(scene, equal): whether both have the scene with one root."""
    both = target.select("scene", F.col("root").alias("want")).join(candidate.select("scene", F.col("root").alias("have")), "scene", "full")
    return both.select("scene", F.coalesce(F.col("want") == F.col("have"), F.lit(False)).alias("equal"))
