"""A corpus of assets: what the deterministic encoders make of each, the manifest of it, and the built-in check."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

import cubiform

from .. import constants as K
from ..sources import candidates, envelopes, forged, programs, wire
from ..sources.assets import profile_of, program_of
from . import compress

cloudpickle.register_pickle_by_value(cubiform)

SCHEMA = (
    "asset string, profile string, format string, root string, encoding_hash string, facts long, source_bytes long, machine_bytes long, compact_bytes long, selected string, selected_bytes long, saved_bytes long, "
    "saved_bps long, machine_units long, compact_units long, milliseconds long, error_kind string, error_code string"
)


def smallest(data: bytes, profile: str | None) -> bytes:
    """The smallest deterministic candidate of the first machine for one asset."""
    target = envelopes.import_asset(data, profile)
    if target.profile == "terrain_delta":
        return compress.terrain(*candidates.read_account(data))
    if target.profile == "forged_item":
        return compress.forged(forged.read_forged_text(data.decode("latin-1")) if wire.detect(data) == K.FORGED else forged.read_forged(data))
    return compress.building(programs.execute(program_of(data)))


def _compact(data: bytes, profile: str, form: str) -> tuple[int, int | None]:
    """(bytes, units) of the compact form; what it can't say is wrapped."""
    wrapped = len(programs.wrap(profile, form, data))
    if profile == "building":
        source = wire.from_base64url(data.strip()[len(K.LEGACY_TEXT) :].decode("latin-1")) if wire.detect(data) == K.LEGACY else data
        found = programs.audit(source)
        return found["compact_bytes"], found["units"]
    return wrapped, None


def measured(asset: str, data: bytes) -> dict:
    """One asset's row: sizes of source, machine and compact form, and the one to keep. Ties stay with the source, then with the compact form."""
    began, profile = time.time(), profile_of(asset)
    target = envelopes.import_asset(data, profile)
    form = wire.detect(data)
    form = {"building": K.LEGACY, "forged_item": K.FORGED}.get(target.profile, K.ACCOUNT) if form == "unknown" else form
    best = smallest(data, target.profile)
    again = envelopes.import_candidate(best, target.profile)
    if again.root != target.root:
        raise wire.FormatError("SemanticMismatch", "baseline")
    source, (compact, units) = len(data), _compact(data, target.profile, form)
    name, size = (K.COMPACT, compact) if compact < source and compact <= len(best) else (K.MACHINE, len(best)) if len(best) < source else (form, source)
    return {
        "asset": asset, "profile": target.profile, "format": form, "root": target.root, "encoding_hash": programs.encoding_hash(target.profile, form, data), "facts": len(target.facts) - (target.profile != "forged_item"),
        "source_bytes": source, "machine_bytes": len(best), "compact_bytes": compact, "selected": name, "selected_bytes": size, "saved_bytes": source - size, "saved_bps": int((source - size) * 10000 / source) if source else 0,
        "machine_units": again.units, "compact_units": units, "milliseconds": int(1000 * (time.time() - began)),
    }


def benchmark(assets: DataFrame) -> DataFrame:
    """One row an asset (asset, content): see measured; a bad asset is a row with its error."""
    fields = [x.split() for x in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asset, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append(measured(asset or "", data or b""))
                except wire.FormatError as e:
                    rows.append({"asset": asset, "error_kind": e.kind, "error_code": e.code})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])

    return assets.select("asset", "content").mapInArrow(read, SCHEMA)


def golden(rows: DataFrame) -> dict:
    """The manifest of a folder of vectors, by profile and name: for a corpus that is read as one file."""
    order = {p: i for i, p in enumerate(K.PROFILES)}
    found = [r.asDict() for r in rows.filter("error_kind is null").drop("error_kind", "error_code", "milliseconds").collect()]
    found.sort(key=lambda r: (order[r["profile"]], r["asset"]))
    return {"format": "golden-v1", "protocol": 1, "vm": 1, "cost_model": 1, "vectors": [r | {"asset": r["asset"].rpartition("/")[2]} for r in found]}


def _vectors() -> dict[str, bytes]:
    """A small asset of each profile: a row of cells, a box, a full component."""
    row = b"".join(i.to_bytes(3, "little") for i in range(16))
    account = K.ACCOUNT_MAGIC.encode() + bytes([1, 0, 16, 0, 64, 0, 0, 0, 0, 0, 0, 0]) + row.ljust(192, b"\0")
    box = programs.write_legacy(programs.Program((8, 8, 8), [{"op": "box", "material": 7, "origin": (0, 0, 0), "size": (8, 4, 8)}]))
    return {"terrain_delta": account, "building": box, "forged_item": bytes.fromhex("f000c0d8000108310518720928b0450081024000")}


def self_test() -> dict:
    """Each profile through import, baseline, task, result and verification; anything amiss is an error."""
    checks = []
    for profile, data in _vectors().items():
        form = {"terrain_delta": K.ACCOUNT, "building": K.LEGACY, "forged_item": K.FORGED}[profile]
        task = envelopes.Task(profile, f"self-test:{profile}", form, data)
        task.root = task.target().root
        result = envelopes.Result(task.task_id, smallest(data, profile), profile)
        report = envelopes.verify(task, result)
        if not report["exact"]:
            raise wire.FormatError("Internal", "self-test-exact")
        if envelopes.read_task(task.to_bytes()) != task or envelopes.read_result(result.to_bytes(), profile) != result:
            raise wire.FormatError("Internal", "self-test-round-trip")
        checks.append({"profile": profile, **{k: report[k] for k in ("exact", "mismatches", "incumbent_bytes", "candidate_bytes", "decode_units", "candidate_root")}})
    return {"ok": True, "checks": checks}
