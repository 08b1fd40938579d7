"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Equal-token blocks go to sources by highest quotients, then within each source to groups of shards
and within those to the shards, by the same rule; inside a shard the documents stand in a seeded order, and its quota of blocks is read off that
order round after round, so a word is taken again only once all of the shard has been taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_repeat: int = 3
    block_tokens: int = 16
    seed: int = 17
    #: Words that a shard should hold.
    shard_tokens: int = 20_000
    #: Shards of a source come in groups of so many, and a source's blocks go to groups first.
    group_shards: int = 1024
    #: Hexadecimal digits of a document's seeded hash that place it in a shard.
    cell_digits: int = 7
    #: A source's facts meet its documents in so many pieces, so that no task gets a hot source whole.
    pieces: int = 256


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """From (absent, name, source_size), a row a source: adds weight and target.

    The sources' targets share all words by weight; none is above max_repeat times its size, and what
    a capped source can't take is shared by weight among the others. That is water filling: in order
    of size for each unit of weight, the first k sources are capped, the others share what is left.
    """
    cycle = F.array(*map(F.lit, mix.weights))
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy("absent", "name")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("place") % len(mix.weights) + 1).cast("int")).cast("long"))
    full = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    cap = mix.max_repeat * F.col("source_size")
    level = ranked.select(
        "*",
        (F.sum("source_size").over(full) - F.coalesce(F.sum(cap).over(filled), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(filled), F.lit(0))).alias("left_weight"),
    )
    # Capped: its even share of what the sources before it leave is above its cap.
    level = level.withColumn("capped", F.col("left_words") * F.col("weight") > cap * F.col("left_weight"))
    open_level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "place", "left_words", "left_weight"))).over(full)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("even.left_words") / F.col("even.left_weight"))
    return level.withColumn("even", open_level).select("absent", "name", "source_size", "place", "weight", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], claim: str, blocks: Column | str) -> DataFrame:
    """Sainte-Lague: within each group, deal its blocks to the parties by highest quotient claim / (2k - 1).

    Seats that every possible divisor grants are given outright; only the few quotients between the
    two extreme divisors are ranked, so the work grows with the parties and not with the blocks.
    Ties go by key. Adds seats.
    """
    whole = Window.partitionBy(*group)
    claim_col, blocks = F.col(claim).cast("double"), (F.col(blocks) if isinstance(blocks, str) else blocks)
    sized = parties.select(
        "*", F.sum(claim_col).over(whole).alias("_total"), F.count(F.lit(1)).over(whole).alias("_n"), blocks.cast("double").alias("_blocks")
    )
    # With divisor d the parties get round(claim / d) seats, which differs from total / d by n / 2 at most.
    share = F.when(F.col("_total") > 0, claim_col / F.col("_total")).otherwise(0.0)
    sure = F.floor(share * F.greatest(F.col("_blocks") - F.col("_n") / 2 - 1, F.lit(0.0)) + 0.5)
    most = F.ceil(share * (F.col("_blocks") + F.col("_n") / 2 + 1) + 0.5)
    sized = sized.withColumn("_sure", sure.cast("long")).withColumn("_most", F.when(claim_col > 0, most.cast("long")).otherwise(F.lit(0)))
    sized = sized.withColumn("_open", F.greatest(F.col("_blocks").cast("long") - F.sum("_sure").over(whole), F.lit(0)))
    seats = sized.filter("_most > _sure").select(*group, *key, "_sure", "_open", claim_col.alias("_claim"), F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat"))
    quotient = F.col("_claim") / (2 * F.col("_seat") - 1)
    best = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), *key, "_seat"))
    won = seats.withColumn("_place", best).filter("_place <= _open").groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    on = list(dict.fromkeys([*group, *key]))
    return sized.join(won, on, "left").withColumn("seats", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(
        "_total", "_n", "_blocks", "_sure", "_most", "_open", "_won"
    )


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns in keep, size, source_size, target and taken.

    A null text has no words; a null source is a source of its own, last in order. Documents that
    share id, size and text digest are interchangeable, so ties never change the rows returned. A
    source without words has target 0. An empty table gives an empty one; extra columns are dropped
    unless kept, and a kept column that clashes with a made one gives way to it.
    """
    keep = tuple(c for c in keep if c not in ("size", "source_size", "target", "taken", doc_id))
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    digest = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(
        F.col(doc_id).alias("_id"), *(F.col(f"`{c}`").alias(f"_keep_{c}") for c in keep),
        F.col(source).isNull().alias("absent"), F.coalesce(F.col(source), F.lit("")).alias("name"), size.alias("_size"), digest.alias("_order"),
    )
    # Words are counted once; what follows reads a few numbers a document.
    rows = cut(rows.withColumn("_cell", F.conv(F.substring("_order", 1, mix.cell_digits), 16, 10).cast("long")), "sizes")
    per_source = targets(rows.groupBy("absent", "name").agg(F.sum("_size").alias("source_size")), mix)
    dealt = apportion(per_source, [], ["place"], "target", F.round(F.sum("target").over(Window.partitionBy()) / mix.block_tokens))
    dealt = dealt.withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / mix.shard_tokens), F.lit(1)).cast("long"))
    facts = cut(dealt.select("absent", "name", "source_size", "target", "seats", "_shards"), "sources")
    spread = facts.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mix.pieces - 1).cast("long"))))
    placed = rows.withColumn("_piece", F.col("_cell") % mix.pieces).join(spread, ["absent", "name", "_piece"])
    placed = placed.withColumn("_shard", F.expr(f"(_cell * _shards) div {16**mix.cell_digits}L"))
    shards = placed.groupBy("absent", "name", "_shard").agg(F.sum("_size").alias("_shard_words"), F.first("seats").alias("_source_seats"))
    shards = cut(shards.withColumn("_group", F.expr(f"_shard div {mix.group_shards}")), "shards")
    source, group = ["absent", "name"], ["absent", "name", "_group"]
    groups = shards.groupBy(*group).agg(F.sum("_shard_words").alias("_group_words"), F.first("_source_seats").alias("_source_seats"))
    groups = apportion(groups, source, ["_group"], "_group_words", "_source_seats").select(*group, F.col("seats").alias("_group_seats"))
    quotas = apportion(shards.drop("_source_seats").join(groups, group), group, ["_shard"], "_shard_words", "_group_seats")
    quota = F.least(F.col("seats") * mix.block_tokens, mix.max_repeat * F.col("_shard_words"))
    quotas = cut(quotas.select(*source, "_shard", "_shard_words", quota.alias("_quota")), "quotas")
    placed = placed.drop("seats", "_shards", "_piece").join(quotas, [*source, "_shard"])
    in_order = Window.partitionBy("absent", "name", "_shard").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_end", F.sum("_size").over(in_order))
    rounds = F.expr("_quota div greatest(_shard_words, 1)")
    rest = F.col("_quota") - rounds * F.col("_shard_words")
    part = F.greatest(F.least(F.col("_end"), rest) - (F.col("_end") - F.col("_size")), F.lit(0))
    return placed.select(
        F.col("_id").alias(doc_id), *(F.col(f"`_keep_{c}`").alias(c) for c in keep),
        F.col("_size").alias("size"), "source_size", "target", (rounds * F.col("_size") + part).alias("taken"),
    )
