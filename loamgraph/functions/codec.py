"""Scalar functions of the store and the graph: key text, lists of differences, coercion, encodings.

Those that are column expressions run in the JVM; the byte-level ones at the end are plain
Python with Arrow-batched wrappers, for reading and writing data of other programs.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- keys: v/<id>, e/<id> for elements; V/<id>/<key>, E/<id>/<key> for properties


def element_key(elem: Column, id_: Column) -> Column:
    """Key of an element: lower-case kind and id."""
    return F.concat(F.lower(elem), F.lit("/"), id_.cast("string"))


def property_key(elem: Column, id_: Column, key: Column) -> Column:
    """Key of a property; without a key that of the element."""
    return F.when(key.isNull(), element_key(elem, id_)).otherwise(F.concat(F.upper(elem), F.lit("/"), id_.cast("string"), F.lit("/"), key))


def last_part(key: Column) -> Column:
    """What follows the last slash; null without a slash."""
    return F.when(F.contains(key, F.lit("/")), F.substring_index(key, "/", -1))


def id_part(key: Column) -> Column:
    """The id in a key, as BIGINT; null if there is none."""
    return F.split_part(key, F.lit("/"), F.lit(2)).try_cast("bigint")


# ---- sorted lists as differences


def delta_encode(xs: Column) -> Column:
    """The sorted list's first value and then the differences; an empty list stays empty."""
    s = F.array_sort(xs)
    return F.transform(s, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(s, i)))


def delta_decode(xs: Column) -> Column:
    """The running sums; each element is the sum of those before it, so for lists in blocks of bounded size."""
    add = lambda acc, x: F.struct((acc["last"] + x).alias("last"), F.array_append(acc["out"], acc["last"] + x).alias("out"))
    return F.aggregate(xs, F.struct(F.lit(0).cast("bigint").alias("last"), F.expr("CAST(array() AS array<bigint>)").alias("out")), add, lambda acc: acc["out"])


# ---- coercion and text forms


def to_long(c: Column) -> Column:
    """BIGINT of a number or its text (a fraction is cut off); null if it is none."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def to_hex(c: Column) -> Column:
    """0x and two lower-case digits per byte."""
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def vertex_text(id_: Column) -> Column:
    return F.format_string("v[%s]", id_.cast("string"))


def edge_text(id_: Column, src: Column, label: Column, dst: Column) -> Column:
    return F.format_string("e[%s][%s-%s->%s]", id_.cast("string"), src.cast("string"), label, dst.cast("string"))


def varint_size(n: Column) -> Column:
    """Bytes of a non-negative BIGINT in groups of seven bits."""
    return F.when(n == 0, 1).otherwise(F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def varint(n: Column) -> Column:
    """BINARY of a non-negative BIGINT in groups of seven bits, lowest first; the highest bit of a byte says that another follows."""
    size = varint_size(n)
    byte = lambda i: F.call_function("shiftright", n, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("bigint")) + F.when(i < size - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def varint_value(data: Column) -> Column:
    """The number of such a BINARY."""
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint").bitwiseAND(F.lit(127).cast("bigint"))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: acc + F.call_function("shiftleft", byte(i), (i * 7).cast("int")))


# ---- typed values as canonical JSON text: 1, 1.0, "1", true, [..] and {..} differ


def json_value(c: Column) -> Column:
    """Any value as JSON text; null, and what JSON cannot say, as null."""
    text = F.to_json(F.array(c))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(inner != "null", inner)


def json_literal(value: Any) -> str:
    """The same of a Python value."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_text(c: Column) -> Column:
    """The text of a JSON string; other values as their JSON."""
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


@F.pandas_udf(T.BinaryType())
def pack_json(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """MessagePack of JSON text."""
    for s in it:
        yield s.map(lambda x: None if x is None else pack(json.loads(x)))


@F.pandas_udf(T.StringType())
def unpack_json(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text of MessagePack values."""
    for s in it:
        yield s.map(lambda x: None if x is None else json_literal(unpack(bytes(x))))


# ---- byte-level encodings


def varint_encode(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def varint_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it)."""
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)  # the Castagnoli polynomial, bits reversed
        table.append(c)
    return table


_CRC = _crc_table()


_CRC_TABLE = np.array(_CRC, np.uint32)


def crc32c(values: Sequence[bytes]) -> np.ndarray:
    """CRC-32C of each value: one step for the bytes at one place of all values, longest values first."""
    lengths = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data, start = np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    c, start, lengths = np.full(len(lengths), 0xFFFFFFFF, np.uint32), start[order], lengths[order]
    n = len(lengths)
    for at in range(int(lengths[0]) if n else 0):
        while lengths[n - 1] <= at:
            n -= 1
        c[:n] = c[:n] >> np.uint32(8) ^ _CRC_TABLE[(c[:n] ^ data[start[:n] + at]) & np.uint32(255)]
    out = np.empty(len(lengths), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c_column(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC-32C of BINARY values."""
    for s in it:
        there = s.notna().to_numpy()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[there] = crc32c([bytes(x) for x in s[there]]).astype(np.int64)
        yield out


_NARROW = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q"))
_SIGNED = ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))


def pack(value: Any) -> bytes:
    """MessagePack of None, bool, int, float, str, bytes, list and dict (the format before separate binary types)."""

    def sized(n: int, small: int, limit: int, code: int) -> bytes:
        return bytes([small | n]) if n < limit else struct.pack(">BH", code, n) if n < 1 << 16 else struct.pack(">BI", code + 1, n)

    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value) if value < 0 else bytes([value])
        for code, form in _NARROW if value >= 0 else _SIGNED:
            try:
                return bytes([code]) + struct.pack(form, value)
            except struct.error:
                continue
        raise ValueError("whole numbers have 64 bits at most")
    if isinstance(value, float):
        return struct.pack(">Bd", 0xCB, value)
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, (bytes, bytearray)):
        return sized(len(value), 0xA0, 32, 0xDA) + bytes(value)
    if isinstance(value, (list, tuple)):
        return sized(len(value), 0x90, 16, 0xDC) + b"".join(map(pack, value))
    if isinstance(value, dict):
        return sized(len(value), 0x80, 16, 0xDE) + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise ValueError(f"{type(value).__name__} cannot be packed")


def unpack(data: bytes, *, text: bool = True) -> Any:
    """Inverse of ``pack``; raw bytes become text if they are UTF-8 and ``text`` is set."""
    at = 0

    def take(form: str) -> Any:
        nonlocal at
        (v,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return v

    def raw(n: int) -> Any:
        nonlocal at
        if at + n > len(data):
            raise ValueError("incomplete data")
        b, at = data[at : at + n], at + n
        try:
            return b.decode() if text else b
        except UnicodeDecodeError:
            return b

    forms = dict((*_NARROW, *_SIGNED, (0xCA, ">f"), (0xCB, ">d")))
    fixed = {0xC0: None, 0xC2: False, 0xC3: True}

    def read() -> Any:
        c = take(">B")
        if c < 0x80 or c >= 0xE0:
            return c if c < 0x80 else c - 256
        if c < 0x90 or c in (0xDE, 0xDF):
            n = c & 15 if c < 0x90 else take(">H" if c == 0xDE else ">I")
            return {k: read() for k in (read() for _ in range(n))}
        if c < 0xA0 or c in (0xDC, 0xDD):
            return [read() for _ in range(c & 15 if c < 0xA0 else take(">H" if c == 0xDC else ">I"))]
        if c < 0xC0 or c in (0xDA, 0xDB):
            return raw(c & 31 if c < 0xC0 else take(">H" if c == 0xDA else ">I"))
        if c in fixed:
            return fixed[c]
        if c in forms:
            return take(forms[c])
        raise ValueError(f"unknown type {c:#x}")

    try:
        value = read()
    except struct.error as e:
        raise ValueError("incomplete data") from e
    if at != len(data):
        raise ValueError("data after the value")
    return value
