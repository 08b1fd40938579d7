"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A sketch of t coordinates is filled in rounds of hashed bin placement: in each of the first t
rounds every shingle falls into a random bin, in round t + j all fall into bin j, and a bin keeps
the least (round, value). So every coordinate fills, after one or two rounds for most texts, and
the share of equal coordinates concentrates around the Jaccard similarity. Texts whose sketches
agree in a band meet in a bucket; links are confirmed on whole shingle sets.

Copies are folded first: texts with one shingle set are one class. In a bucket only the pairs with
a central class are verified (a star). Pairs across the components that this leaves apart follow
in a second step, and of those only the ones that counts of rare shingles don't rule out: every
link counts, though no group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import components
from .store import arrow_map, discard, freed, prepare, without

U64 = np.uint64


@dataclass(frozen=True)
class NearRules:
    """Two texts of similarity 0.75 miss all 32 bands of 4 rows with a chance of 5 in a million."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    seed: int = 11
    #: A shingle of at most so many classes counts as rare.
    rare: int = 16


def _seeds(count: int, seed: int) -> np.ndarray:
    return tc.mix((np.arange(count, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed))


def sketch(keys: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit keys; seeds has 2t of them."""
    none = U64(0xFFFFFFFFFFFFFFFF)
    found = np.full(t, none, U64)
    done, shift = 0, U64(64 - int(t).bit_length() - 1)
    while done < t:
        some = seeds[done : min(t, done + max(1, 4 * t // len(keys)))]
        h = tc.mix(keys[:, None] ^ some[None, :])
        bins = (h % U64(t)).astype(np.int64)
        rounds = np.arange(done, done + len(some), dtype=U64) << shift
        np.minimum.at(found, bins.ravel(), ((h // U64(t) >> U64(64) - shift) | rounds[None, :]).ravel())
        done += len(some)
        if not (found == none).any():
            return found
    for j in np.flatnonzero(found == none):
        found[j] = tc.mix(keys ^ seeds[t + j]).min() >> U64(64) - shift | U64(t + j) << shift
    return found


def shingle_sets(column: pa.Array, rules: NearRules) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text; empty for a text without words."""
    data, offsets = tc.utf8(column)
    empty = np.zeros(0, U64)
    for _, _, part, at in tc.slices(data, offsets):
        part = tc.LOWER[part]
        starts, ends, word_at = tc.words(part, at, tc.SPACED)
        keys = tc.hashes(part, starts, ends)
        grams = tc.ngrams(keys, rules.shingle)
        for lo, hi in zip(word_at[:-1].tolist(), word_at[1:].tolist()):
            if hi - lo >= rules.shingle:
                yield np.unique(grams[lo : hi - rules.shingle + 1])
            elif hi > lo:  # a short text is one shingle of all its words
                yield tc.mix(tc.ngrams(keys[lo:hi], hi - lo) + U64(hi - lo))
            else:
                yield empty


def class_key(keys: np.ndarray) -> bytes:
    """128 bits that tell one shingle set from another."""
    with np.errstate(over="ignore"):
        return int(tc.mix(keys + U64(1)).sum(dtype=U64)).to_bytes(8, "big") + int(tc.mix(keys ^ U64(0x5DEECE66D)).sum(dtype=U64)).to_bytes(8, "big")


def sketched(docs: DataFrame, doc_id: str, text: str, rules: NearRules) -> DataFrame:
    """(doc_id, n_shingles, node, bands): node is null and bands empty for an empty set."""
    t = rules.bands * rules.rows
    seeds = _seeds(2 * t, rules.seed)
    salts = _seeds(rules.bands, rules.seed + 1)
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for keys in shingle_sets(batch.column(1), rules):
                sizes.append(len(keys))
                if len(keys):
                    nodes.append(class_key(keys))
                    coordinates = sketch(keys, t, seeds).reshape(rules.bands, rules.rows)
                    bands.append(tc.mix(np.bitwise_xor.reduce(tc.mix(coordinates + np.arange(rules.rows, dtype=U64) * U64(0x9E3779B97F4A7C15)), axis=1) ^ salts).view(np.int64))
                else:
                    nodes.append(None)
                    bands.append(np.zeros(0, np.int64))
            at = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(at, flat)], ["doc_id", "n_shingles", "node", "bands"])

    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), judge, f"doc_id {kind}, n_shingles long, node binary, bands array<long>")


def _sets(docs: DataFrame, needed: DataFrame, doc_id: str, text: str, rules: NearRules) -> DataFrame:
    """(node, keys): the whole shingle sets of the needed classes, (node, first_id, n), each from its row of least id.

    The join on the id comes first and filters the scan, so that only needed texts are shuffled;
    classes without an id are found among the rows without one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    wanted = needed.filter("n >= 1").select(F.col("node").alias("need"), "first_id")
    named = rows.join(wanted, F.col("doc_id") == F.col("first_id")).select("text", "need")
    nameless = rows.filter("doc_id is null").select("text", F.lit(None).cast("binary").alias("need"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(class_key(k), k, need) for k, need in zip(shingle_sets(batch.column(0), rules), batch.column(1).to_pylist()) if len(k)]
            kept = [(node, k) for node, k, need in found if need is None or need == node]
            at = np.concatenate(([0], np.cumsum([len(k) for _, k in kept]))).astype(np.int32)
            flat = np.concatenate([k for _, k in kept] or [np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.binary()), pa.ListArray.from_arrays(at, flat)], ["node", "keys"])

    made = "node binary, keys array<long>"
    return arrow_map(named, judge, made).union(arrow_map(nameless, judge, made).join(needed.filter("first_id is null").select("node"), "node", "left_semi"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. sets: one row a node."""
    left = pairs.filter("a < b").join(sets.select(F.col("node").alias("a"), F.col("keys").alias("a_keys")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("keys").alias("b_keys")), "b")
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("a_keys") + F.size("b_keys")).alias("total"))
    return both.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def _across(placed: DataFrame, sets: DataFrame, tried: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs (a, b), not tried yet, that share a bucket, belong to different components and may still be similar.

    placed: (band, node, n, label) of the buckets that hold several components. A shingle is rare
    when few of these classes have it. Pairs with a rare shingle in common come from the shingle. All
    other pairs share none of their rare shingles, which bounds their similarity by counts alone:
    shared <= min(n - rare), union >= max(n + rare of the other). Only pairs that meet the bound
    leave the join, each from the first of its buckets.
    """
    member = placed.groupBy("node", "n", "label").agg(F.array_sort(F.collect_list("band")).alias("within"))  # at most one for each band
    listed = sets.join(member.select("node", "n", "label"), "node").select("node", "n", "label", F.explode("keys").alias("key"))
    rare = listed.groupBy("key").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") <= rules.rare)
    rare = freed(listed.join(rare, "key"), "rare")
    counts = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    shared = rare.filter("owners > 1").groupBy("key").agg(F.collect_list(F.struct("node", "n", "label")).alias("of"))
    pair = shared.select(F.explode("of").alias("x"), "of").select("x", F.explode("of").alias("y")).filter("x.label < y.label")
    met = pair.filter(f"100 * least(x.n, y.n) >= {rules.percent} * greatest(x.n, y.n)").select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    known = member.join(counts, "node", "left").select("node", "n", "label", "within", F.coalesce("rare", F.lit(0)).alias("rare"))
    known = freed(known, "member")
    left = placed.select("band", "node").join(known, "node")
    right = left.select("band", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "within", "rare")))
    bound = f"label < label2 and 100 * least(n - rare, n2 - rare2) >= {rules.percent} * greatest(n + rare2, n2 + rare) and array_min(array_intersect(within, within2)) = band"
    rest = left.join(right.withColumnRenamed("band", "band2"), F.expr(f"band = band2 and {bound}"))
    found = met.union(rest.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))).distinct()
    found = freed(found.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(rare, known)
    return found


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: NearRules = NearRules()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept.

    component_id is the least doc_id reachable over links, kept whether it is the row's own. A null or
    blank text has an empty set, links with nothing and keeps itself. Rows with a null doc_id take part
    under their texts but are never the least while another id is there; repeated rows share one group.
    Extra columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    base = freed(sketched(docs, doc_id, text, rules), "sketch")
    # A class has one shingle set, so all its rows have the same bands.
    carried = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    carried = freed(carried, "carried")
    rows = freed(base.drop("bands"), "rows")
    discard(base)
    bands = carried.select("node", "n", F.explode("bands").alias("band"))
    crowded = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    bands = freed(bands.join(crowded, "band"), "bands")
    classes = freed(carried.drop("bands"), "classes")
    discard(carried)
    central = bands.groupBy("node", "n").agg(F.sum("members").alias("weight"))
    # The hub of a bucket is the class that meets most others over all bands.
    ranked = bands.join(central, ["node", "n"])
    hubs = ranked.groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    tried = bands.join(hubs, "band").filter("node <> hub.node").select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), F.least("n", "hub.n").alias("low"), F.greatest("n", "hub.n").alias("high")
    )
    similar = F.expr(f"100 * low >= {rules.percent} * high")
    tried = freed(tried.filter(similar).select("a", "b").distinct(), "pairs")
    paired = tried.select(F.col("a").alias("node")).union(tried.select("b")).union(bands.filter("members > 2").select("node")).distinct()
    needed = freed(paired.join(classes, "node"), "needed")
    sets = _sets(docs, needed, doc_id, text, rules)
    # One row a class; only rows that repeat id and text, or have no id, give more.
    again = rows.filter("node is not null").groupBy("node", "doc_id").count().filter("count > 1 or doc_id is null")
    sets = freed(sets if again.isEmpty() else sets.dropDuplicates(["node"]), "sets")
    links = freed(_verified(tried, sets, rules.percent), "links")
    labels = freed(components(links), "labels")
    placed = bands.filter("members > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = placed.groupBy("band").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("band")
    placed = freed(placed.join(apart, "band").select("band", "node", "n", "label"), "apart")
    discard(bands, needed)
    across = _across(placed, sets, tried, rules)
    discard(placed, tried)
    more = freed(_verified(across, sets, rules.percent), "links")
    discard(sets, across)
    if not more.isEmpty():
        discard(labels)
        labels = freed(components(links.union(more)), "labels")
    discard(links, more)
    member = classes.join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    # Written out, so that the join on the label of a hot component can be split.
    least = freed(member.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    found = rows.join(member.join(least, "label").select("node", "component_id"), "node", "left")
    found = found.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: NearRules = NearRules()) -> DataFrame:
    """docs without the documents whose group has a smaller id.

    Rows that share an id are one document: they stay or go together. Rows with a null id stay.
    """
    gone = near_groups(docs, doc_id, text, rules).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct()
    return without(docs, doc_id, freed(gone, "gone"))
