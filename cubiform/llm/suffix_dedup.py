"""Suffix-array dedup: removes every byte covered by a long string that also starts elsewhere.

Strings that repeat share anchors (see anchors). First, anchors of short strings show which stretches
of which documents can hold anything that repeats. The long strings of those stretches are dealt by
their own anchors to shards, where suffix arrays, built by induced sorting, and permuted common
prefixes tell how much each start shares with another one. Equal runs are sorted once, whoever has
them, with their number; neighbouring runs of a document stand in a shard as one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, suffixes
from . import textcore as tc
from .store import arrow_map, cut, discard, prepare, ref


@dataclass(frozen=True)
class RepeatRules:
    """least: bytes of a string that goes. passage, gram: bytes of the strings, and of their anchors, that show stretches.

    shard_bytes: text of a suffix array, before its last unit. A unit is the runs that a document has in
    common with later ones, within unit_span of its bytes; above unit_bytes it is dealt by single
    anchors, and an anchor above unit_bytes by its strings.
    """

    least: int = 400
    passage: int = 240
    gram: int = 112
    shard_bytes: int = 1 << 20
    unit_bytes: int = 1 << 20
    unit_span: int = 1 << 16


_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _found(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of arrays of structs: where each row's entries begin (n + 1 places), and the fields of all entries."""
    column = _found(batch, name)
    at = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(column)))))
    flat = column.flatten()
    return at, {f.name: pa.compute.struct_field(flat, f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _lists(offsets: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
    kinds = {np.dtype("int32"): pa.int32(), np.dtype("int64"): pa.int64()}
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(v, kinds[v.dtype]) for v in fields.values()], list(fields)))


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _anchored(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(row1, row2, key, low, high, at): the runs of short strings of all documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(batch.column(2))
            for first, _, part, at in tc.slices(data, offsets):
                low, high, anchor, key = anchors.runs(part, at, rules.passage, rules.gram)
                doc = np.searchsorted(at, low, "right") - 1
                rows, own = pa.array(first + doc), at[doc]
                yield _batch(
                    row1=batch.column(0).take(rows), row2=batch.column(1).take(rows), key=pa.array(key.view(np.int64)),
                    low=pa.array((low - own).astype(np.int32)), high=pa.array((high - own).astype(np.int32)), at=pa.array((anchor - own).astype(np.int32)),
                )

    return arrow_map(docs.select("row1", "row2", "text"), read, "row1 long, row2 long, key long, low int, high int, at int")


def ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the runs of true marks."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _stretches(seen: DataFrame, rules: RepeatRules) -> DataFrame:
    """(row1, row2, n_shared, starts): bytes of anchors that stand elsewhere; starts whose long strings have no other anchors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs = _listed(batch, "runs")
            shared, sizes, firsts, ends = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                low, high, anchor = (runs[c][a:b].astype(np.int64) for c in ("low", "high", "at"))
                size = int(max(high.max() + 1, anchor.max() + rules.gram))
                shared.append(int(tc.covered(anchor, anchor + rules.gram, size).sum()))
                first, end = ranges(tc.covered(low, high + 1, size))
                end = end - (rules.least - rules.passage)
                some = end > first
                firsts.append(first[some].astype(np.int32))
                ends.append(end[some].astype(np.int32))
                sizes.append(int(some.sum()))
            yield _batch(
                row1=_found(batch, "row1"), row2=_found(batch, "row2"), n_shared=pa.array(shared, pa.int64()),
                starts=_lists(np.cumsum(sizes), first=np.concatenate(firsts), end=np.concatenate(ends)),
            )

    return arrow_map(seen, read, "row1 long, row2 long, n_shared long, starts array<struct<first:int,end:int>>")


def _runs(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(row1, row2, key, context, low, high): the runs of long strings of docs, which have starts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(_found(batch, "text"))
            at, starts = _listed(batch, "starts")
            for i in range(len(batch)):
                a, b = at[i], at[i + 1]
                low, high, key, context = anchors.contexts(data[offsets[i] : offsets[i + 1]], starts["first"][a:b], starts["end"][a:b], rules.least, rules.gram)
                rows = pa.array(np.full(len(low), i))
                yield _batch(
                    row1=_found(batch, "row1").take(rows), row2=_found(batch, "row2").take(rows), key=pa.array(key.view(np.int64)),
                    context=pa.array(context.view(np.int64)), low=pa.array(low.astype(np.int32)), high=pa.array(high.astype(np.int32)),
                )

    return arrow_map(docs, read, "row1 long, row2 long, key long, context long, low int, high int")


def _strings(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """As _runs, a run for each start of the runs in crowd, dealt by the whole string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(_found(batch, "text"))
            at, crowd = _listed(batch, "crowd")
            for i in range(len(batch)):
                total = tc.running(data[offsets[i] : offsets[i + 1]])
                low, size = crowd["low"][at[i] : at[i + 1]].astype(np.int64), crowd["high"][at[i] : at[i + 1]].astype(np.int64) + 1
                size -= low
                start = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                key = tc.mix(tc.spans(total, start, start + rules.least) + np.uint64(rules.least)).view(np.int64)
                rows = pa.array(np.full(len(start), i))
                place = pa.array(start.astype(np.int32))
                yield _batch(row1=_found(batch, "row1").take(rows), row2=_found(batch, "row2").take(rows), key=pa.array(key), context=pa.array(key), low=place, high=place)

    return arrow_map(docs, read, "row1 long, row2 long, key long, context long, low int, high int")


def _pieces(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(unit, body, runs): neighbouring runs of a document and a unit, with the bytes of all their strings."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(_found(batch, "text"))
            at, asked = _listed(batch, "asked")
            doc = np.repeat(np.arange(len(batch)), np.diff(at))
            order = np.lexsort((asked["low"], doc))
            doc, asked = doc[order], {c: v[order] for c, v in asked.items()}
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (asked["unit"][1:] != asked["unit"][:-1]) | (asked["low"][1:] != asked["high"][:-1] + 1)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(doc)) - 1
            starts, ends = offsets[doc[first]] + asked["low"][first], offsets[doc[last]] + asked["high"][last] + rules.least
            runs = _lists(np.append(first, len(doc)), key=asked["key"], context=asked["context"], size=(asked["high"] - asked["low"] + 1).astype(np.int32), copies=asked["copies"])
            body = pa.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())
            yield _batch(unit=pa.array(asked["unit"][first]), body=body, runs=runs)

    return arrow_map(docs, read, "unit long, body binary, runs array<struct<key:long,context:long,size:int,copies:long>>")


def _compared(pieces: DataFrame, rules: RepeatRules) -> DataFrame:
    """(key, context, spans): the starts of a run, from its first, whose strings begin elsewhere too. pieces come ordered by unit."""

    def judged(held: list[tuple]) -> pa.RecordBatch:
        runs = {c: np.concatenate([r[c] for _, r in held]) for c in held[0][1]}
        size = runs["size"].astype(np.int64)
        shared = suffixes.longest_shared([b for b, _ in held], [int(r["size"].sum()) for _, r in held])
        # Equal runs were sorted once: what has copies shares all of its strings with them.
        again = (shared >= rules.least) | np.repeat(runs["copies"] > 1, size)
        run = np.repeat(np.arange(len(size)), size)
        edge = np.ones(len(run) + 1, bool)
        edge[1:-1] = (again[1:] != again[:-1]) | (run[1:] != run[:-1])
        place = np.flatnonzero(edge)
        first, end = place[:-1], place[1:]
        first, end = first[again[first]], end[again[first]]
        own = (np.cumsum(size) - size)[run[first]]
        found, at = np.unique(run[first], return_index=True)
        spans = _lists(np.append(at, len(first)), first=(first - own).astype(np.int32), end=(end - own).astype(np.int32))
        return _batch(key=pa.array(runs["key"][found]), context=pa.array(runs["context"][found]), spans=spans)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            at, runs = _listed(batch, "runs")
            for i, (unit, body) in enumerate(zip(_found(batch, "unit").to_pylist(), _found(batch, "body").to_pylist())):
                if unit != last and size >= rules.shard_bytes:
                    yield judged(held)
                    held, size = [], 0
                last = unit
                held.append((body, {c: v[at[i] : at[i + 1]] for c, v in runs.items()}))
                size += len(body)
        if held:
            yield judged(held)

    return arrow_map(pieces, read, "key long, context long, spans array<struct<first:int,end:int>>")


CUT = "n_removed long, n_spans long, kept_sha256 string, removed array<struct<first:long,end:long>>, kept_text string"


def _applied(docs: DataFrame, rules: RepeatRules, texts: bool) -> DataFrame:
    """What is left of docs, which have marks: starts of strings that go."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(_found(batch, "text"))
            at, marks = _listed(batch, "marks")
            rows = []
            for i in range(len(batch)):
                body = data[offsets[i] : offsets[i + 1]]
                a, b = at[i], at[i + 1]
                gone = tc.covered(marks["first"][a:b], marks["end"][a:b] + (rules.least - 1), len(body))
                left = body[~gone].tobytes()
                first, end = ranges(gone)
                spans = [{"first": x, "end": y} for x, y in zip(first.tolist(), end.tolist())]
                rows.append((int(gone.sum()), len(spans), hashlib.sha256(left).hexdigest(), spans, left.decode("utf-8", "ignore") if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string())
            names = ("n_removed", "n_spans", "kept_sha256", "removed", "kept_text")
            yield _batch(row1=_found(batch, "row1"), row2=_found(batch, "row2"), **{c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, kinds))})

    return arrow_map(docs, read, f"row1 long, row2 long, {CUT}")


def _shared_starts(texts: DataFrame, starts: DataFrame, rules: RepeatRules) -> DataFrame:
    """(row1, row2, marks): starts of long strings that begin elsewhere too, of the starts that may."""
    rows = ["row1", "row2"]
    runs = cut(_runs(texts.join(starts.filter(F.size("starts") > 0).select(*rows, "starts"), rows), rules), "runs")

    def kinds(some: DataFrame) -> DataFrame:
        return some.groupBy("key", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*rows, "low", "high")).alias("one"))

    kind = cut(kinds(runs), "kinds")
    width = F.col("one.high") - F.col("one.low") + rules.least
    keys = kind.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(width.cast("long")).alias("bytes"), F.min("one").alias("rep")).filter("n > 1")
    keys = keys.withColumn("home", F.xxhash64("rep.row1", "rep.row2", F.expr(f"rep.low div {rules.unit_span}"))).select("key", "bytes", "home")
    keys = cut(keys, "keys")
    # An anchor that very many different runs share is dealt by the strings themselves.
    crowds = keys.filter(F.col("bytes") > rules.unit_bytes).select("key")
    crowd = runs.join(crowds, "key").groupBy(*rows).agg(F.collect_list(F.struct("low", "high")).alias("crowd"))
    strings = cut(_strings(texts.join(crowd, rows), rules), "strings")
    few = keys.filter(F.col("bytes") <= rules.unit_bytes)
    homes = few.groupBy("home").agg(F.sum("bytes").alias("home_bytes"))
    dealt = few.join(homes, "home").select("key", F.when(F.col("home_bytes") > rules.unit_bytes, F.col("key")).otherwise(F.col("home")).alias("unit"))
    alike = kinds(strings).filter("copies > 1").withColumn("unit", F.col("key"))
    asked = kind.join(dealt, "key").unionByName(alike)
    asked = asked.select("one.row1", "one.row2", F.struct(F.col("one.low").alias("low"), F.col("one.high").alias("high"), "key", "context", "copies", "unit").alias("run"))
    pieces = cut(_pieces(texts.join(asked.groupBy(*rows).agg(F.collect_list("run").alias("asked")), rows), rules), "pieces")
    tasks = int((pieces.agg(F.sum(F.length("body"))).first()[0] or 0) // (2 * rules.shard_bytes)) + 1
    spans = cut(_compared(pieces.repartition(tasks, "unit").sortWithinPartitions("unit"), rules), "spans")
    every = runs.unionByName(strings).join(spans, ["key", "context"])
    marks = F.transform("spans", lambda s: F.struct((s["first"] + F.col("low")).alias("first"), (s["end"] + F.col("low")).alias("end")))
    found = cut(every.select(*rows, marks.alias("marks")).groupBy(*rows).agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")
    discard(runs, kind, keys, strings, pieces, spans)
    return found


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, rules: RepeatRules = RepeatRules(), texts: bool = False) -> DataFrame:
    """The columns in keep (all but text when None) with n_bytes, n_removed, n_spans, kept_sha256, removed

    (byte ranges), n_shared and, if texts is set, kept_text (what is left, without code points cut in half).
    n_shared counts bytes of anchors that stand elsewhere too: every string of passage bytes has one, so that
    passages too short to be removed show.

    A null text is empty; empty and short texts lose nothing; very long ones are dealt by their parts.
    Repeated rows are copies of each other and lose all bytes that long strings cover. Of clashing input
    columns the outputs win. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    made = ["n_bytes", *(x.split()[0] for x in CUT.split(", ")), "n_shared"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    body = F.coalesce(F.col(text), F.lit(""))
    # A row is known by hashes of its id and of its text: rows that agree in both are alike in all that follows.
    known = docs.select(*(ref(c).alias(f"_keep_{c}") for c in keep), F.xxhash64(F.col(doc_id).cast("string")).alias("row1"), F.xxhash64(body).alias("row2"), body.alias("text"))
    rows = known.select("row1", "row2", "text")
    short = cut(_anchored(rows, rules), "anchors")
    twice = cut(short.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "twice")
    seen = short.join(twice, "key").groupBy("row1", "row2").agg(F.collect_list(F.struct("low", "high", "at")).alias("runs"))
    starts = cut(_stretches(seen, rules), "stretches")
    discard(short, twice)
    marks = _shared_starts(rows, starts, rules)
    left = _applied(rows.join(marks, ["row1", "row2"]), rules, texts).dropDuplicates(["row1", "row2"])
    facts = known.select(
        *(ref(f"_keep_{c}") for c in keep), "row1", "row2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_whole"),
        (F.col("text") if texts else F.lit(None).cast("string")).alias("_text"),
    )
    joined = facts.join(starts.select("row1", "row2", "n_shared"), ["row1", "row2"], "left").join(left, ["row1", "row2"], "left")
    return joined.select(
        *(ref(f"_keep_{c}").alias(c) for c in keep), "n_bytes", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<struct<first:long,end:long>>")).alias("removed"),
        F.coalesce("kept_text", "_text").alias("kept_text"), F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"),
    )
