"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts texts where it is least among its neighbours, so
cuts depend on the bytes nearby alone and come back after an insertion. Chunks vary in size, are
deduplicated by digest, and the copy in the document with the least id stays.
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
from pyspark.sql.types import StructField, StructType

from . import textcore as tc
from .anchors import window_least
from .store import arrow_map, cut, prepare, ref

U64 = np.uint64
#: 128 bits that tell one chunk from another.
DIGEST = np.dtype([("high", np.int64), ("low", np.int64)])


@dataclass(frozen=True)
class ChunkRules:
    """reach: a cut's hash is least among so many neighbours on either side; chunks have 2 * reach bytes or so.

    least_run: bytes of neighbouring shared chunks that make a repeat; less is left alone, unless it is a whole document.
    """

    reach: int = 24
    least_run: int = 96
    window_steps: int = 4
    seed: int = 29


def gear(data: np.ndarray, offsets: np.ndarray, rules: ChunkRules) -> np.ndarray:
    """At each byte the gear hash, sum of value(byte k places back) << k, over 2**window_steps bytes of its document."""
    values = tc.mix((np.arange(256, dtype=U64) + U64(rules.seed)) * U64(0x9E3779B97F4A7C15))[data]
    begins = offsets[:-1][np.diff(offsets) > 0]
    sizes = np.diff(np.append(begins, len(data)))
    for step in range(rules.window_steps):
        reach = 1 << step
        ahead = values.copy()
        if len(values) > reach:
            ahead[reach:] += values[:-reach] << U64(reach)
        # The first bytes of a document have nothing behind them.
        for k in range(reach):
            first = begins[sizes > k] + k
            ahead[first] = values[first]
        values = ahead
    return tc.mix(values)


def chunks(data: np.ndarray, offsets: np.ndarray, rules: ChunkRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, digests, where each document's chunks begin): chunks cover all bytes of a slice."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, DIGEST), np.zeros(len(offsets), np.int64)
    hashes, reach = gear(data, offsets, rules), rules.reach
    wide = np.full(len(data) + 2 * reach, np.iinfo(np.uint64).max, U64)
    wide[reach:-reach] = hashes
    least = window_least(wide, 2 * reach + 1)
    cut_at = hashes == least
    # Of equal neighbours none but the first cuts, so that periodic text stays one chunk.
    before = window_least(wide[: len(data) + reach - 1], reach) if len(data) + reach - 1 >= reach else wide[:0]
    cut_at[: len(before)] &= hashes[: len(before)] < before
    # Near a document's end the neighbours belong to another: no cuts there.
    steps = np.zeros(len(data) + 1, np.int64)
    full = np.flatnonzero(np.diff(offsets) > 2 * reach)
    np.add.at(steps, offsets[full] + reach, 1)
    np.add.at(steps, offsets[full + 1] - reach, -1)
    cut_at &= np.cumsum(steps)[:-1] > 0
    starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(cut_at) + 1)))
    ends = np.append(starts[1:], len(data))
    digests = np.empty(len(starts), DIGEST)
    for lane, name in enumerate(DIGEST.names):
        digests[name] = tc.mix(tc.spans(tc.running(data, lane), starts, ends, lane) + (ends - starts).astype(U64)).view(np.int64)
    return starts, digests, np.searchsorted(starts, offsets)


def _found(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _digested(docs: DataFrame, kind: str, rules: ChunkRules) -> DataFrame:
    """(id, row, high, low, times): each document's different chunks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(_found(batch, "text"))
            for first, end, part, at in tc.slices(data, offsets):
                _, digests, chunk_at = chunks(part, at, rules)
                doc = np.repeat(np.arange(first, end), np.diff(chunk_at))
                order = np.lexsort((digests["low"], digests["high"], doc))
                doc, digests = doc[order], digests[order]
                fresh = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | _changes(digests)))) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(doc))).astype(np.int64)
                rows = pa.array(doc[fresh])
                yield pa.RecordBatch.from_arrays([_found(batch, "id").take(rows), _found(batch, "row").take(rows), *(pa.array(digests[n][fresh]) for n in DIGEST.names), pa.array(times)], ["id", "row", "high", "low", "times"])

    return arrow_map(docs.select("id", "row", "text"), read, f"id {kind}, row long, high long, low long, times long")


def _changes(digests: np.ndarray) -> np.ndarray:
    """Which digests differ from the one before."""
    return (digests["high"][1:] != digests["high"][:-1]) | (digests["low"][1:] != digests["low"][:-1])


def _numbered(digests: np.ndarray) -> np.ndarray:
    """Equal numbers for equal digests."""
    order = np.lexsort((digests["low"], digests["high"]))
    number = np.empty(len(digests), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(_changes(digests[order]))))
    return number


def _pairs(column: pa.ListArray) -> np.ndarray:
    """All digests of a column of arrays."""
    flat = column.flatten()
    found = np.empty(len(flat), DIGEST)
    for name in DIGEST.names:
        found[name] = pa.compute.struct_field(flat, name).to_numpy(zero_copy_only=False)
    return found


FACTS = "n_bytes long, n_chunks long, n_shared long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _applied(docs: DataFrame, keep: list[str], rules: ChunkRules, texts: bool) -> DataFrame:
    schema = StructType([StructField(c, docs.schema[f"_keep_{c}"].dataType) for c in keep] + StructType.fromDDL(FACTS).fields)
    made = [x.split()[0] for x in FACTS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(_found(batch, "text"))
            lists = {c: _pairs(_found(batch, c)) for c in ("owned", "shared")}
            at_list = {c: np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(_found(batch, c)))))) for c in lists}
            rows = []
            for first, end, part, at in tc.slices(data, offsets):
                starts, digests, chunk_at = chunks(part, at, rules)
                bounds = np.append(starts, len(part))
                for i in range(end - first):
                    a, n = int(at[i]), int(at[i + 1] - at[i])
                    own, other = (lists[c][at_list[c][first + i] : at_list[c][first + i + 1]] for c in ("owned", "shared"))
                    lo, hi = chunk_at[i], chunk_at[i + 1]
                    shared = gone = spans = 0
                    left = None
                    if len(own) or len(other):
                        some, sizes = digests[lo:hi], np.diff(bounds[lo : hi + 1])
                        # Digests by number: those of the document, then what it owns and what it shares.
                        number = _numbered(np.concatenate((some, own, other)))
                        elsewhere = np.isin(number[: len(some)], number[len(some) + len(own) :])
                        repeat = elsewhere | np.isin(number[: len(some)], number[len(some) : len(some) + len(own)])
                        _, earliest = np.unique(number[: len(some)], return_index=True)
                        # Runs of shared chunks that are too short are left alone, unless they are all of a document.
                        whole = elsewhere.all() or len(earliest) == len(some) and not elsewhere.any()
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], repeat.view(np.int8), [0]))))
                        total = np.concatenate(([0], np.cumsum(sizes)))
                        for x, y in zip(edges[::2], edges[1::2]):
                            if total[y] - total[x] < rules.least_run and not (whole and y - x == len(some)):
                                repeat[x:y] = False
                        again = np.ones(len(some), bool)
                        again[earliest] = False
                        drop = repeat & (elsewhere | again)
                        shared, gone = int(sizes[repeat].sum()), int(sizes[drop].sum())
                        spans = int((np.diff(np.concatenate(([0], drop.view(np.int8)))) == 1).sum())
                        if gone:
                            left = part[a : a + n][np.repeat(~drop, sizes)].tobytes()
                    body = part[a : a + n].tobytes() if left is None else left
                    rows.append((n, int(hi - lo), shared, gone, spans, hashlib.sha256(body).hexdigest(), body.decode("utf-8", "ignore") if texts else None))
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*(_found(batch, f"_keep_{c}") for c in keep), *columns], [*keep, *made])

    return arrow_map(docs, read, schema)


def dedup_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, rules: ChunkRules = ChunkRules(), texts: bool = False) -> DataFrame:
    """The columns in keep (all but text when None) with n_bytes, n_chunks, n_shared, n_removed, n_spans, kept_sha256

    and, if texts is set, kept_text. n_shared counts bytes of repeats, the copy that stays included;
    n_removed those that go; n_spans the runs that go.

    A null text is empty; a very long one is chunked whole. Rows that share an id are one document: neither is the other's copy. A null
    id is the last in order, and all rows with it count as one document. Of clashing input columns the
    outputs win; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    made = [x.split()[0] for x in FACTS.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*(ref(c).alias(f"_keep_{c}") for c in keep), F.col(doc_id).alias("id"), F.xxhash64(body).alias("row"), body.alias("text"))
    parts = _digested(rows, kinds[doc_id], rules)
    digest = list(DIGEST.names)
    # An owner is the least id with the chunk; min() passes over nulls.
    owners = parts.groupBy(*digest).agg(F.min("id").alias("owner"), F.sum("times").alias("n")).filter("n > 1")
    owners = cut(owners.select(*digest, "owner"), "owners")
    marks = parts.select("id", "row", *digest).join(owners, digest).groupBy(F.col("id").alias("mark_id"), F.col("row").alias("mark_row")).agg(
        F.collect_set(F.when(F.expr("id <=> owner"), F.struct(*digest))).alias("owned"), F.collect_set(F.when(F.expr("not (id <=> owner)"), F.struct(*digest))).alias("shared")
    )
    none = F.array().cast("array<struct<high:long,low:long>>")
    joined = rows.join(cut(marks, "marks"), F.expr("row = mark_row and id <=> mark_id"), "left")
    return _applied(joined.withColumn("owned", F.coalesce("owned", none)).withColumn("shared", F.coalesce("shared", none)), keep, rules, texts)
