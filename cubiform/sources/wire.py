"""Byte and bit cursors of the wire formats, and the error every malformed input ends in."""

from __future__ import annotations

import base64
import re

import numpy as np

from .. import constants as K


class FormatError(ValueError):
    """kind is the class of failure, code what exactly is wrong."""

    def __init__(self, kind: str, code: str):
        super().__init__(f"{kind}: {code}")
        self.kind, self.code = kind, code


_SHORT = [bytes([v]) for v in range(128)]


def varint(v: int) -> bytes:
    """Seven bits a byte, least first."""
    if 0 <= v < 128:
        return _SHORT[v]
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def varints(values: np.ndarray) -> bytes:
    """varint of each value, none below zero, joined."""
    if not len(values) or values.max() < 128:
        return values.astype(np.uint8).tobytes()
    places = np.arange(-(-int(values.max()).bit_length() // 7))
    parts = values[:, None] >> 7 * places
    more = np.zeros(parts.shape, bool)
    more[:, :-1] = parts[:, 1:] > 0
    kept = (parts > 0) | (places == 0)
    return (parts & 127 | more * 128)[kept].astype(np.uint8).tobytes()


def varint_size(v: int) -> int:
    """Bytes of varint(v)."""
    return 1 if v < 128 else 2 if v < 16384 else -(-v.bit_length() // 7)


def zigzag(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def unzigzag(v: int) -> int:
    return v >> 1 if v % 2 == 0 else -(v + 1 >> 1)


class Bytes:
    """Reads forward and never past the end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("Truncated", "bytes")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def varint(self, most_bytes: int = 5) -> int:
        value = 0
        for k in range(most_bytes):
            b = self.byte()
            value |= (b & 127) << 7 * k
            if b < 128:
                if k and not b:
                    raise FormatError("NonCanonical", "varint")
                if value >= 1 << (32 if most_bytes == 5 else 64):
                    raise FormatError("ArithmeticOverflow", "varint")
                return value
        raise FormatError("ArithmeticOverflow", "varint")

    def signed(self) -> int:
        return unzigzag(self.varint())

    def block(self) -> bytes:
        return self.take(self.varint())

    def end(self) -> None:
        if self.at != len(self.data):
            raise FormatError("TrailingData", "bytes")


class BitReader:
    """Most significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.size = data, at * 8, len(data) * 8

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise FormatError("Truncated", "bits")
        first, last = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[first:last], "big") >> last * 8 - self.at - n
        self.at += n
        return value & (1 << n) - 1

    def read_signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if value >> n - 1 else value

    def align(self) -> int:
        """The place of the next whole byte; what is skipped must be zero."""
        left = -self.at % 8
        if left and self.read(left):
            raise FormatError("NonCanonical", "padding")
        return self.at // 8


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def write(self, v: int, n: int) -> None:
        if v < 0 or v >> n:
            raise FormatError("OutOfBounds", "field-width")
        self.value, self.n = self.value << n | v, self.n + n

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def gaps(ids: list[int]) -> list[int]:
    """The first id, then what lies between neighbours; they must rise strictly."""
    out, before = [], -1
    for i in ids:
        if i <= before:
            raise FormatError("NonCanonical", "order")
        out.append(i - before - 1)
        before = i
    return out


def read_gaps(r: Bytes, n: int) -> list[int]:
    out, before = [], -1
    for _ in range(n):
        before += r.varint() + 1
        out.append(before)
    return out


def pack_mask(mask: list[int]) -> bytes:
    if not mask:
        return b""
    if not all(bit in (0, 1) for bit in mask):
        raise FormatError("OutOfBounds", "field-width")
    whole = -(-len(mask) // 8)
    return int(bytes(mask).translate(_DIGITS).ljust(8 * whole, b"0"), 2).to_bytes(whole, "big")


def read_mask(r: Bytes, n: int) -> list[int]:
    whole = -(-n // 8)
    digits = f"{int.from_bytes(r.take(whole), 'big'):0{8 * whole}b}" if n else ""
    if "1" in digits[n:]:
        raise FormatError("NonCanonical", "padding")
    return list(map(int, digits[:n]))


#: 0 and 1 as digits.
_DIGITS = bytes(b"01") + bytes(254)


def from_base64url(text: str) -> bytes:
    if not re.fullmatch("[A-Za-z0-9_-]+", text) or len(text) % 4 == 1:
        raise FormatError("InvalidEncoding", "base64url")
    data = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    if to_base64url(data) != text:
        raise FormatError("NonCanonical", "base64url")
    return data


def to_base64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def detect(data: bytes) -> str:
    """The format that a payload's beginning names."""
    body = data.strip(b" \t\n\x0c\r")
    return next((name for prefix, name in K.BEGINNINGS if body.startswith(prefix.encode())), "unknown")
