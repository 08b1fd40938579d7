"""Scalar functions of the encodings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def varint_length(v: ColumnOrName) -> Column:
    """Bytes of a canonical base-128 integer below 2**63."""
    v = _c(v)
    return sum(((v >= F.lit(1 << 7 * k)).cast("int") for k in range(1, 9)), F.lit(1))


def varint_hex(v: ColumnOrName) -> Column:
    """The integer in groups of seven bits, least first, as hex; for values below 2**35."""
    v = _c(v).cast("long")
    groups = []
    for k in range(5):
        group = F.shiftright(v, 7 * k).bitwiseAND(127)
        more = v >= F.lit(1 << 7 * (k + 1))
        byte = F.lpad(F.hex(group + F.when(more, 128).otherwise(0)), 2, "0")
        groups.append(F.when(v >= F.lit(1 << 7 * k), byte).otherwise("") if k else byte)
    return F.lower(F.concat(*groups))


def zigzag(v: ColumnOrName) -> Column:
    v = _c(v).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: ColumnOrName) -> Column:
    v = _c(v).cast("long")
    return F.shiftright(v, 1).bitwiseXOR(-v.bitwiseAND(1))


def odd_signed(v: ColumnOrName) -> Column:
    """Odd values are negative: -(v + 1) / 2; even ones v / 2."""
    v = _c(v).cast("long")
    return F.when(v % 2 == 1, -F.shiftright(v + 1, 1)).otherwise(F.shiftright(v, 1))


def delta_field(v: ColumnOrName) -> Column:
    """A translation of -256 .. 256 in its ten-bit field; null outside."""
    return F.when(_c(v).between(-256, 256), zigzag(v))


def bits_needed(v: ColumnOrName) -> Column:
    """Bits of the largest value of a field, one at least."""
    v = _c(v)
    return F.length(F.regexp_replace(F.bin(F.greatest(v.cast("long"), F.lit(1))), "^0+", "")).cast("int")


def building_id(x: ColumnOrName, y: ColumnOrName, z: ColumnOrName, sx: ColumnOrName, sz: ColumnOrName) -> Column:
    return _c(x) + _c(sx) * (_c(z) + _c(sz) * _c(y))


def terrain_id(x: ColumnOrName, y: ColumnOrName, z: ColumnOrName) -> Column:
    return _c(x) + K.TERRAIN_GRID[0] * (_c(z) + K.TERRAIN_GRID[2] * _c(y))


def forge_id(x: ColumnOrName, y: ColumnOrName, z: ColumnOrName) -> Column:
    return _c(x) + K.FORGE_GRID[0] * (_c(y) + K.FORGE_GRID[1] * _c(z))


def split_id(i: ColumnOrName, first: ColumnOrName | int, second: ColumnOrName | int) -> tuple[Column, Column, Column]:
    """The three coordinates, in the order in which the id counts them."""
    i = _c(i)
    first = F.lit(first) if isinstance(first, int) else _c(first)
    second = F.lit(second) if isinstance(second, int) else _c(second)
    over = F.floor(i / first)
    return i % first, over % second, F.floor(over / second)


def base64url(binary: ColumnOrName) -> Column:
    """Unpadded base64 in the URL alphabet."""
    text = F.regexp_replace(F.base64(_c(binary)), "[\r\n]", "")
    return F.rtrim(F.translate(text, "+/", "-_"), F.lit("="))


def unbase64url(text: ColumnOrName) -> Column:
    """The bytes of canonical unpadded base64url; null for anything else, such as loose trailing bits."""
    t = _c(text)
    padded = F.concat(F.translate(t, "-_", "+/"), F.repeat(F.lit("="), ((4 - F.length(t) % 4) % 4).cast("int")))
    fine = t.rlike("^[A-Za-z0-9_-]+$") & (F.length(t) % 4 != 1)
    found = F.when(fine, F.unbase64(padded))
    return F.when(base64url(found) == t, found)


def trim_ascii(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"^[\x09\x0a\x0c\x0d\x20]+|[\x09\x0a\x0c\x0d\x20]+$", "")


def detect_format(text: ColumnOrName) -> Column:
    """The format that a text's or (latin-1) payload's beginning names."""
    t = trim_ascii(text)
    found = F.lit("unknown")
    for prefix, name in reversed(K.BEGINNINGS):
        found = F.when(F.startswith(t, F.lit(prefix)), name).otherwise(found)
    return found


def domain_hash(domain: str, *parts: Column) -> Column:
    """Lower-case hex of SHA-256 over the domain, a zero byte and the parts, given as hex."""
    return F.sha2(F.unhex(F.concat(F.lit(domain.encode().hex() + "00"), *parts)), 256)


def semantic_root(profile: str, canonical_hex: ColumnOrName) -> Column:
    return domain_hash(K.SEMANTIC_DOMAIN, F.lit(f"{K.PROFILES[profile]:02x}"), _c(canonical_hex))


def encoding_hash(profile: str, format_name: str, payload_hex: ColumnOrName) -> Column:
    return domain_hash(K.ENCODING_DOMAIN, F.lit(f"{K.PROFILES[profile]:02x}{K.FORMATS[format_name]:02x}"), _c(payload_hex))


def saved_bps(source: ColumnOrName, candidate: ColumnOrName) -> Column:
    """Basis points saved, toward zero; 0 where the source is empty."""
    saved = (_c(source) - _c(candidate)) * 10000
    return F.when(_c(source) == 0, F.lit(0)).otherwise(F.when(saved >= 0, F.floor(saved / _c(source))).otherwise(F.ceil(saved / _c(source)))).cast("long")
