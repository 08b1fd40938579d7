"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is an aggregation to a minimum (combined before the shuffle) and a join; nothing of the
graph reaches the driver but two sums that tell whether a round changed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, freed


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (a, b) the rows (node, label): label is the least node that can be reached.

    Nodes without an edge to another aren't listed; nulls aren't nodes; repeated edges and loops
    don't matter; an empty table gives an empty one.
    """
    ordered = F.least("a", "b"), F.greatest("a", "b")
    stars = freed(edges.filter("a <> b").select(ordered[0].alias("a"), ordered[1].alias("b")).distinct(), "edges")
    before = _signature(stars)
    for _ in range(most_rounds):
        # Large star: each node ties its larger neighbours to the least of its neighbourhood.
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least of each is written out, so that the join on a node with very many others can be split.
        least = freed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # Small star: each node ties its smaller neighbours, and itself, to the least of them.
        large = freed(large, "edges")
        low = freed(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        tied = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        tied = tied.union(low.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()
        old, stars = stars, freed(tied, "edges")
        discard(old, least, large, low)
        after = _signature(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    pairs = stars.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return pairs.union(stars.select(F.col("a").alias("node"), F.col("a").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
