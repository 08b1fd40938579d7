"""Toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - threshold_k): the ordered thresholds share one weight vector. x holds
the shares that words and beginnings of words, hashed to slots, have in the text, for those that
labelled documents tie to the grade; the expected severity of a text is the sum over thresholds of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .store import Shared, arrow_map, cut, output_schema, prepare


@dataclass(frozen=True)
class ToxicityRules:
    """max_rows bounds the labelled documents of the fit: half of them toxic, half not, by seeded hash.

    A feature takes part if its count among toxic documents is least_z deviations from what chance
    gives, in either direction. limit applies to P(grade > 0).
    """

    bits: int = 21
    #: Lengths, in bytes, of the beginnings of longer words that are features too.
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    max_rows: int = 8_000
    least_z: float = 5.0
    epochs: int = 400
    rate: float = 0.3
    decay: float = 1e-3
    limit: float = 0.5
    seed: int = 5


def grades(toxic: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Ordered grades: 0 not toxic, 1 toxic, 2 toxic and of low quality as well."""
    return np.where(toxic > 0, 1 + (quality <= 0), 0)


def slots(data: np.ndarray, offsets: np.ndarray, rules: ToxicityRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot) of all words, lower-cased, and of their beginnings, and each document's words."""
    part = tc.LOWER[data]
    starts, ends, word_at = tc.words(part, offsets, tc.ALNUM)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(word_at))
    total = tc.running(part)
    shift = np.uint64(64 - rules.bits)
    found = [(doc, tc.spans(total, starts, ends) >> shift)]
    for k in rules.prefixes:
        long = np.flatnonzero(ends - starts > k)
        found.append((doc[long], tc.mix(tc.spans(total, starts[long], starts[long] + k) + np.uint64(k)) >> shift))
    return np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found]).astype(np.int64), np.diff(word_at)


def weigh(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How much of a text a feature makes up; a fixed 50 words more keep short texts in bounds."""
    return counts * 50.0 / (words + 50.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Ordinal:
    """Weights of all slots (mostly 0) and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit(row: np.ndarray, slot: np.ndarray, share: np.ndarray, grade: np.ndarray, rules: ToxicityRules) -> Ordinal:
    """Fits on (row, slot, share) entries of the telling features; full-batch AdaGrad on the cumulative-link likelihood.

    Toxic rows and others weigh evenly. Without rows, or with only one of the two, all weights are 0
    and every text is below the limit.
    """
    levels = max(int(grade.max(initial=0)), 1)
    model = Ordinal(np.zeros(1 << rules.bits), np.arange(levels) + 2.0)
    toxic = grade > 0
    used = np.unique(slot)
    if len(np.unique(toxic)) < 2 or not len(used):
        return model
    rate = float(toxic.mean())
    place = np.full(1 << rules.bits, -1)
    place[used] = np.arange(len(used))
    column = place[slot]
    above = (grade[:, None] > np.arange(levels)[None, :]).astype(float)
    even = np.where(toxic, 0.5 / rate, 0.5 / (1 - rate))[:, None] / len(grade)
    w, w_total = np.zeros(len(used)), np.full(len(used), 1e-8)
    cut, cut_total = model.thresholds.copy(), np.full(levels, 1e-8)
    for _ in range(rules.epochs):
        wrong = (sigmoid(np.bincount(row, w[column] * share, len(grade))[:, None] - cut[None, :]) - above) * even
        step = np.bincount(column, wrong.sum(axis=1)[row] * share, len(used)) + rules.decay * w / len(used)
        w_total += step**2
        w -= rules.rate * step / np.sqrt(w_total)
        cut_step = -wrong.sum(axis=0)
        cut_total += cut_step**2
        cut = np.maximum.accumulate(cut - rules.rate * cut_step / np.sqrt(cut_total))
    model.weights[used], model.thresholds = w, cut
    return model


def fit_table(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: ToxicityRules = ToxicityRules()) -> Ordinal:
    """Fits on labelled documents, read and counted on the executors; the driver gets the telling features only.

    Those are what the labels explain, a few of the 2**bits there are; each of the max_rows documents
    has an entry for each at most. Rows with a null id, text or label teach nothing; a repeated label
    row teaches again; very long texts are read whole.
    """
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("_id"), F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality")).dropna()
    order = F.xxhash64(F.lit(rules.seed), "_id"), F.col("_id"), F.col("toxic"), F.col("quality")
    half = rules.max_rows // 2
    chosen = known.filter("toxic > 0").orderBy(*order).limit(half).unionByName(known.filter("toxic <= 0").orderBy(*order).limit(half))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").filter("_text is not null")
    grade = F.when(F.col("toxic") > 0, 1 + (F.col("quality") <= 0).cast("int")).otherwise(0)
    table = cut(_featured(rows.select("_text", F.col("_id").cast("string").alias("key"), grade.alias("grade")), rules), "features")
    count, rate = table.agg(F.count(F.lit(1)), F.avg((F.col("grade") > 0).cast("double"))).first()
    if not count:
        return fit(*(np.zeros(0, np.int64),) * 2, np.zeros(0), np.zeros(0, np.int64), rules)
    counts = _counted(table).groupBy("slot").agg(F.sum("every").alias("every"), F.sum("toxic").alias("toxic"))
    z = F.abs(F.col("toxic") - F.col("every") * rate) / F.sqrt(F.col("every") * rate * (1 - rate) + 1e-9)
    used = np.sort(np.array([r.slot for r in counts.filter(z >= rules.least_z).select("slot").collect()], np.int32))
    found = _selected(table, Shared(spark, used)).toArrow().sort_by([("key", "ascending"), ("grade", "ascending")]).combine_chunks()  # one order, so that sums agree from run to run
    row = np.repeat(np.arange(found.num_rows), np.asarray(pa.compute.list_value_length(found.column("slots"))))
    flat = lambda name: found.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(row, flat("slots").astype(np.int64), flat("shares").astype(float), found.column("grade").to_numpy(), rules)


_FEATURES = "key string, grade int, slots array<int>, shares array<float>"


def _featured(rows: DataFrame, rules: ToxicityRules) -> DataFrame:
    """(key, grade, slots, shares) of (text, key, grade): each text's different features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(batch.column(0))
            found = []
            for _, _, part, at in tc.slices(data, offsets):
                doc, slot, words = slots(part, at, rules)
                both, counts = np.unique(doc << rules.bits | slot, return_counts=True)
                ends = np.searchsorted(both, np.arange(len(at), dtype=np.int64) << rules.bits)
                shares = weigh(counts, words[both >> rules.bits]).astype(np.float32)
                both = (both & (1 << rules.bits) - 1).astype(np.int32)
                found += [(both[a:b], shares[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *_listed(found)], ["key", "grade", "slots", "shares"])

    return arrow_map(rows, read, _FEATURES)


def _listed(found: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.ListArray]:
    at = np.concatenate(([0], np.cumsum([len(f) for f, _ in found]))).astype(np.int32)
    return [pa.ListArray.from_arrays(at, np.concatenate([*x, none])) for x, none in (([f for f, _ in found], np.zeros(0, np.int32)), ([v for _, v in found], np.zeros(0, np.float32)))]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.asarray(pa.compute.list_value_length(column)))


def _counted(table: DataFrame) -> DataFrame:
    """(slot, every, toxic): in how many texts of a batch a feature stands, and in how many toxic ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, row = _lists(batch.column(1))
            toxic = batch.column(0).to_numpy(zero_copy_only=False)[row] > 0
            every, at = np.unique(slot, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.bincount(at, minlength=len(every))), pa.array(np.bincount(at[toxic], minlength=len(every)))], ["slot", "every", "toxic"])

    return arrow_map(table.select("grade", "slots"), read, "slot int, every long, toxic long")


def _selected(table: DataFrame, used: Shared) -> DataFrame:
    """The same rows with those features alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = used.load()
        for batch in batches:
            slot, row = _lists(batch.column(2))
            share, _ = _lists(batch.column(3))
            kept = np.isin(slot, some)
            at = np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=len(batch))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x[kept], t)) for x, t in ((slot, pa.int32()), (share, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "grade", "slots", "shares"])

    return arrow_map(table, read, _FEATURES)


def grade_texts(docs: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """The columns in keep (all when None) with severity, p_toxic and toxic.

    Whole texts are read; a null or empty text has no features and gets the grade that thresholds
    alone give; of a clashing input column the output wins; an empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    made = ["severity", "p_toxic", "toxic"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = output_schema(docs, keep, "severity double, p_toxic double, toxic boolean")
    shared = spark.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.thresholds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, thresholds = shared.value
        weights = np.zeros(1 << rules.bits)
        weights[used] = values
        one, listed = Ordinal(weights, thresholds), weights != 0
        for batch in batches:
            data, offsets = tc.utf8(batch.column(batch.schema.get_field_index(text)))
            score = np.zeros(batch.num_rows)
            for first, end, part, at in tc.slices(data, offsets):
                doc, slot, words = slots(part, at, rules)
                places = np.flatnonzero(listed[slot])
                score[first:end] = weigh(np.bincount(doc[places], weights[slot[places]], end - first), words)
            above = one.above(score)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= rules.limit)], [*keep, *made])

    return arrow_map(docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text]))), judge, schema)
