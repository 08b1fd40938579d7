"""Population tables of a search: order, elites, survivors, injection, first-seen, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitness() -> Column:
    """Exact before inexact, then fewer mismatches, bytes, units, then the lesser encoding."""
    return F.struct((F.col("mismatches") > 0).alias("inexact"), "mismatches", "bytes", "units", "encoding", "slot")


def ranked(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("island").orderBy(fitness())))


def elites(candidates: DataFrame, k: int) -> DataFrame:
    return ranked(candidates).filter(F.col("rank") <= k)


def rank_key() -> Column:
    """What orders candidates before they are evaluated: (invalid, cost, mismatches, ops, slot).

    cost is what the commands and the cheapest guess at the residual take: patches one by one, runs of
    them, or a bitmap. From valid, ops, mask_bytes, volume, slot and the prefilter statistics.
    """
    sparse = 3 * F.col("mismatches") + F.col("sets") + F.col("paints")
    bitmap = F.ceil(F.col("volume") / 8) + 2 * F.col("paints")
    cost = 6 * F.col("ops") + F.col("mask_bytes") + F.least(sparse, 6 * F.col("runs"), bitmap)
    return F.struct((~F.col("valid")).alias("invalid"), cost.cast("long").alias("cost"), "mismatches", "ops", "slot")


def survivors(candidates: DataFrame, k: int) -> DataFrame:
    """The best k candidates of each island by the rank key, with cost and rank."""
    keyed = candidates.withColumn("_key", rank_key())
    best = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("island").orderBy("_key"))).filter(F.col("rank") <= k)
    return best.withColumn("cost", F.col("_key.cost")).drop("_key")


def inject_best(candidates: DataFrame) -> DataFrame:
    """The best of all islands takes the last place of every island that hasn't its encoding."""
    best = candidates.orderBy(fitness()).limit(1).select(*(F.col(c).alias(f"best_{c}") for c in ("mismatches", "bytes", "units", "encoding")))
    placed = ranked(candidates)
    whole = Window.partitionBy("island")
    last = placed.withColumn("size", F.count(F.lit(1)).over(whole)).crossJoin(F.broadcast(best))  # one row
    last = last.withColumn("has", F.max(F.col("encoding") == F.col("best_encoding")).over(whole))
    swap = ~F.col("has") & (F.col("rank") == F.col("size"))
    return last.select("island", "rank", *(F.when(swap, F.col(f"best_{c}")).otherwise(F.col(c)).alias(c) for c in ("mismatches", "bytes", "units", "encoding")))


def first_seen(candidates: DataFrame) -> DataFrame:
    """Adds fresh: whether a candidate's encoding is the first of its island in slot order."""
    return candidates.withColumn("fresh", F.row_number().over(Window.partitionBy("island", "encoding").orderBy("slot")) == 1)


def progress(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("island").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("mismatches") == 0).alias("exact"), F.min(F.when(F.col("mismatches") == 0, F.col("bytes"))).alias("best_bytes"))
