"""Asset files as tables. Parsing is per file and runs on the executors; a bad file is a row with its error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import cubiform

from .. import constants as K
from . import envelopes, programs, wire

cloudpickle.register_pickle_by_value(cubiform)

ASSET_SCHEMA = "asset string, format string, profile string, bytes long, facts long, root string, error_kind string, error_code string"
COMMAND_SCHEMA = (
    "scene string, seq long, op string, material long, material2 long, ox long, oy long, oz long, sx long, sy long, sz long, axis long, length long, u long, v long, thickness long, depth long, width long, "
    "count long, dx long, dy long, dz long, height long, crown long, spacing long, mask array<long>, px long, py long, pz long, turns long, pivot_twice long, dim_x long, dim_y long, dim_z long, "
    "error_kind string, error_code string"
)


def dicts(lists: pa.ListArray) -> list[list[dict]]:
    """Arrays of structs as lists of dicts, made by column."""
    flat, ends = lists.flatten(), [0]
    for n in lists.value_lengths().to_pylist():
        ends.append(ends[-1] + (n or 0))
    names = [f.name for f in flat.type]
    rows = [dict(zip(names, values)) for values in zip(*(c.to_pylist() for c in flat.flatten()))]
    return [rows[a:b] for a, b in zip(ends, ends[1:])]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(asset, content) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("asset"), "content")


def profile_of(name: str) -> str | None:
    """The profile that an asset's name tells, for payloads that don't say theirs."""
    low = name.lower()
    return next((p for p, words in (("terrain_delta", ("terrain",)), ("building", ("building",)), ("forged_item", ("forge",))) if any(w in low for w in words)), None)


def decoded(assets: DataFrame) -> DataFrame:
    """One row an asset (asset, content): format, profile, size, root, or the error that stopped it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asset, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                row = {"asset": asset, "format": wire.detect(data), "bytes": len(data)}
                try:
                    found = envelopes.import_asset(data, profile_of(asset or ""))
                    row |= {"profile": found.profile, "facts": len(found.facts) - (found.profile != "forged_item"), "root": found.root}
                except wire.FormatError as e:
                    row |= {"error_kind": e.kind, "error_code": e.code}
                rows.append(row)
            names = [x.split()[0] for x in ASSET_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.int64() if n in ("bytes", "facts") else pa.string()) for n in names], names)

    return assets.select("asset", "content").mapInArrow(read, ASSET_SCHEMA)


def _flat(scene: str, seq: int, op: dict, size) -> dict:
    name = op["op"]
    if name == "gable":
        name = f"gable_{('outline', 'trim', 'fill')[op['style']]}_{'z' if op['z_oriented'] else 'x'}"
    row = {"scene": scene, "seq": seq, "op": name, "material2": op.get("leaf"), "dim_x": size[0], "dim_y": size[1], "dim_z": size[2]}
    for key, columns in (("origin", ("ox", "oy", "oz")), ("source", ("ox", "oy", "oz")), ("size", ("sx", "sy", "sz")), ("delta", ("dx", "dy", "dz")), ("target", ("px", "py", "pz"))):
        row |= dict(zip(columns, op.get(key, ())))
    return row | {k: op.get(k) for k in ("material", "axis", "length", "u", "v", "thickness", "depth", "width", "count", "height", "crown", "spacing", "mask", "turns", "pivot_twice")}


def listed_op(row: dict) -> dict:
    """A command as the interpreter takes it, from a row of the command table."""
    name, op = row["op"], {k: v for k, v in row.items() if k in _PLAIN and v is not None}
    if name.startswith("gable_"):
        _, style, turned = name.split("_")
        op |= {"style": K.GABLE_STYLES.index(style), "z_oriented": int(turned == "z")}
        name = "gable"
    moves = name in MOVES
    for key, columns in (("source" if moves else "origin", ("ox", "oy", "oz")), ("size", ("sx", "sy", "sz")), ("delta", ("dx", "dy", "dz")), ("target", ("px", "py", "pz"))):
        if all(row.get(c) is not None for c in columns):
            op[key] = tuple(int(row[c]) for c in columns)
    if name == "tree":
        op["leaf"] = row["material2"]
    return {"op": name, **op}


_PLAIN = {"material", "axis", "length", "u", "v", "thickness", "depth", "width", "count", "height", "crown", "spacing", "mask", "turns", "pivot_twice"}
#: Commands that copy cells.
MOVES = ("translate", "rotate_y", "mirror", "repeat_region")


def program_of(data: bytes) -> programs.Program:
    """The program of a building asset, compact or legacy, as bytes or text."""
    name = wire.detect(data)
    if name == K.COMPACT:
        return programs.decode(data if data.startswith(K.COMPACT_MAGIC.encode()) else wire.from_base64url(data.strip()[len(K.COMPACT_TEXT) :].decode("latin-1")))
    return programs.read_legacy(wire.from_base64url(data.strip()[len(K.LEGACY_TEXT) :].decode("latin-1")) if name == K.LEGACY else data)


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _per_asset(assets: DataFrame, schema: str, made: Callable[[str, bytes], list[dict]], key: str) -> DataFrame:
    """The rows that made gives for each asset; a bad file gives a row with key and its error."""
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asset, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += made(asset, data or b"")
                except wire.FormatError as e:
                    rows.append({key: asset, "error_kind": e.kind, "error_code": e.code})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[k]) for n, k in fields], [n for n, _ in fields])

    return assets.select("asset", "content").mapInArrow(read, schema)


def commands(assets: DataFrame) -> DataFrame:
    """The commands of building assets, a row each, for the scene operators; a bad file is a row without an op."""

    def made(asset: str, data: bytes) -> list[dict]:
        program = program_of(data)
        return [_flat(asset, seq, op, program.size) for seq, op in enumerate(program.ops)]

    return _per_asset(assets, COMMAND_SCHEMA, made, "scene")


def residuals(assets: DataFrame) -> DataFrame:
    """(scene, id, kind, material, error_kind, error_code): the patches that compact assets hold besides their commands."""

    def made(asset: str, data: bytes) -> list[dict]:
        return [{"scene": asset, "id": i, "kind": kind, "material": m} for i, kind, m in program_of(data).patches]

    return _per_asset(assets, "scene string, id long, kind long, material long, error_kind string, error_code string", made, "scene")


def audited(assets: DataFrame) -> DataFrame:
    """What the compact form saves on each legacy building: the audit columns and the bytes chosen, or the error."""
    schema = (
        "asset string, source_bytes long, compact_bytes long, wrapped_bytes long, saved_bytes long, saved_bps long, voxels long, units long, root string, selected string, deep_search boolean, encoding binary, "
        "error_kind string, error_code string"
    )

    def made(asset: str, data: bytes) -> list[dict]:
        source = wire.from_base64url(data.strip()[len(K.LEGACY_TEXT) :].decode("latin-1")) if wire.detect(data) == K.LEGACY else data
        return [{"asset": asset} | programs.audit(source)]

    return _per_asset(assets, schema, made, "asset")


def _byte(at) -> Column:
    """The byte at a place of content, counted from 0."""
    return F.conv(F.hex(F.substring(F.col("content"), (F.lit(at) if isinstance(at, int) else at).cast("int") + 1, F.lit(1))), 16, 10).cast("long")


def _word(at: int) -> Column:
    return _byte(at) + 256 * _byte(at + 1)


def _records() -> Column:
    """0 .. count - 1 of an account's header."""
    return F.when(_word(6) > 0, F.sequence(F.lit(0).cast("long"), _word(6) - 1)).otherwise(F.array().cast("array<long>"))


def account_fault() -> Column:
    """What is wrong with a terrain account, (kind, code), or null: its beginning, version, size or a record."""
    wrong = lambda kind, code: F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"))
    size, capacity = F.octet_length("content"), _word(8)
    found = F.when(F.col("content").isNull() | (size < 16) | (F.substring("content", 1, 4) != F.lit(K.ACCOUNT_MAGIC.encode())), wrong("InvalidEncoding", "magic"))
    found = found.when(_byte(4) != 1, wrong("UnsupportedVersion", "account")).when((capacity > 2048) | (_word(6) > capacity) | (size != 16 + 3 * capacity), wrong("Truncated", "account"))
    return found.when(F.exists(_records(), lambda i: _byte(18 + 3 * i) > 1), wrong("NonCanonical", "record"))


def account_faults(assets: DataFrame) -> DataFrame:
    """(asset, kind, code) of accounts that can't be read."""
    return assets.select("asset", account_fault().alias("fault")).filter("fault is not null").select("asset", "fault.kind", "fault.code")


def accounts(assets: DataFrame) -> DataFrame:
    """(asset, min_y, id) of terrain accounts, in DataFrame functions alone: no byte leaves the JVM. See account_faults for the others."""
    good = assets.filter(account_fault().isNull())
    each = good.select("asset", F.when(_word(10) > 32767, _word(10) - 65536).otherwise(_word(10)).alias("min_y"), "content", F.explode(_records()).alias("i"))
    v = sum((_byte(16 + k + 3 * F.col("i")) * (1 << 8 * k) for k in range(3)), F.lit(0))
    x, z, y = v % 16, F.floor(v / 16) % 16, F.floor(v / 256)
    return each.select("asset", "min_y", (x + 16 * (z + 16 * y)).alias("id")).distinct()
