"""Protobuf wire format without a schema, and fixed-layout structs, in Arrow-batched functions.

Of a malformed message, scan() gives the fields before the fault and fault() says what it is; unpacked(), walk() and
unpack_struct() give null, never a part of it."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.batched import batched

FIELD = "struct<num:int,type:int,raw:decimal(20,0),data:binary>"
#: Deepest nesting and most fields of a walk.
DEPTH, FIELDS = 64, 100_000
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
#: Packed kinds: struct format of fixed-width ones.
FIXED = {"fixed32": "<I", "fixed64": "<Q", "sfixed32": "<i", "sfixed64": "<q", "float32": "<f", "float64": "<d"}


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("varint")
        value |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return value & (1 << 64) - 1, at
        shift += 7


def write_varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def fields(b: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, type, raw value, data) of each field."""
    at = 0
    while at < len(b):
        tag, at = read_varint(b, at)
        num, kind = tag >> 3, tag & 7
        if not 0 < num < 1 << 29:
            raise ValueError("field number")
        raw, data = 0, b""
        if kind == VARINT:
            raw, at = read_varint(b, at)
        elif kind in (FIXED64, FIXED32, BYTES):
            size, at = (8, at) if kind == FIXED64 else (4, at) if kind == FIXED32 else read_varint(b, at)
            data = b[at : at + size]
            at += size
            if len(data) < size:
                raise ValueError("cut off")
            if kind != BYTES:
                raw, data = int.from_bytes(data, "little"), b""
        else:
            raise ValueError("group")
        yield num, kind, raw, data


def _safe(f):
    def one(b):
        try:
            return None if b is None else f(bytes(b))
        except (ValueError, struct.error):
            return None

    return one


def _row(x) -> dict:
    return {"num": x[0], "type": x[1], "raw": Decimal(x[2]), "data": x[3]}


def until_fault(b: bytes) -> tuple[list, str | None]:
    """The fields before the first fault, and the fault."""
    found = []
    try:
        for x in fields(b):
            found.append(_row(x))
    except ValueError as e:
        return found, str(e)
    return found, None


@batched(f"array<{FIELD}>")
def scan(values: pd.Series) -> pd.Series:
    """All fields in order, up to the first fault (see fault()); explode it for rows."""
    return values.map(lambda b: None if b is None else until_fault(bytes(b))[0])


@batched("string")
def fault(values: pd.Series) -> pd.Series:
    """Why a message can't be read to its end; null if it can."""
    return values.map(lambda b: None if b is None else until_fault(bytes(b))[1])


def find(message: Column, num: int, last: bool = False) -> Column:
    """The first (or last) field with a number, null if there is none."""
    hits = F.filter(scan(message), lambda x: x["num"] == num)
    return F.try_element_at(hits, F.lit(-1 if last else 1))


def find_path(message: Column, *path: int) -> Column:
    """The field at the end of a path of nested messages."""
    found = find(message, path[0])
    for num in path[1:]:
        found = find(found["data"], num)
    return found


def signed(raw: Column) -> Column:
    """An unsigned 64-bit value as two's complement."""
    return F.when(raw >= F.lit("9223372036854775808").cast("decimal(20,0)"), raw - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(raw).cast("bigint")


def unzigzagged(raw: Column) -> Column:
    half = F.floor(raw / 2)
    return F.when(raw % 2 == 0, half).otherwise(-half - 1).cast("bigint")


def unpacked(message: Column, kind: str) -> Column:
    """The numbers of a packed field: varint, sint, bool, or one of FIXED; 64-bit unsigned ones as decimal(20,0)."""
    out = {"varint": "decimal(20,0)", "fixed64": "decimal(20,0)", "sint": "bigint", "bool": "boolean", "float32": "double", "float64": "double"}.get(kind, "bigint")

    def read(b: bytes) -> list:
        if kind in FIXED:
            size = struct.calcsize(FIXED[kind])
            if len(b) % size:
                raise ValueError("cut off")
            found = [x[0] for x in struct.iter_unpack(FIXED[kind], b)]
            return [Decimal(x) for x in found] if kind == "fixed64" else found
        found, at = [], 0
        while at < len(b):
            x, at = read_varint(b, at)
            found.append(Decimal(x) if kind == "varint" else bool(x) if kind == "bool" else (x >> 1) ^ -(x & 1))
        return found

    @batched(f"array<{out}>")
    def all_values(values: pd.Series) -> pd.Series:
        return values.map(_safe(read))

    return all_values(message)


def packed(numbers: Column, num: int, kind: str) -> Column:
    """An array as one packed field; null and empty arrays give no bytes."""

    def write(xs) -> bytes:
        if xs is None or len(xs) == 0:
            return b""
        if kind in FIXED:
            body = b"".join(struct.pack(FIXED[kind], float(x) if kind.startswith("float") else int(x)) for x in xs)
        else:
            body = b"".join(write_varint((int(x) << 1) ^ (int(x) >> 63) if kind == "sint" else int(x)) for x in xs)
        return write_varint(num << 3 | BYTES) + write_varint(len(body)) + body

    @batched("binary")
    def to_bytes(values: pd.Series) -> pd.Series:
        return values.map(write)

    return to_bytes(numbers)


def field(value: Column, num: int, kind: str) -> Column:
    """One encoded field: varint, sint, bool, a kind of FIXED, string, bytes or message; null gives no bytes."""

    def write(x) -> bytes:
        if x is None or x != x:
            return b""
        if kind in ("string", "bytes", "message"):
            body = x.encode() if isinstance(x, str) else bytes(x)
            return write_varint(num << 3 | BYTES) + write_varint(len(body)) + body
        if kind in FIXED:
            return write_varint(num << 3 | (FIXED32 if FIXED[kind][1] in "Iif" else FIXED64)) + struct.pack(FIXED[kind], float(x) if kind.startswith("float") else int(x))
        x = int(x)
        return write_varint(num << 3) + write_varint((x << 1) ^ (x >> 63) if kind == "sint" else x)

    @batched("binary")
    def to_bytes(values: pd.Series) -> pd.Series:
        return values.map(write)

    if kind in ("varint", "sint", "bool") or kind in FIXED and not kind.startswith("float"):
        value = value.cast("decimal(20,0)")  # whole numbers stay whole beside nulls
    return to_bytes(value)


def map_entry(num: int, key: Column, value: Column) -> Column:
    """A map entry of an encoded key (field 1) and value (field 2)."""
    return field(F.concat(key, value), num, "message")


def map_entries(message: Column, num: int) -> Column:
    """The entries of a map field: an array of (key, value) fields; a missing part is null."""
    hits = F.filter(scan(message), lambda x: (x["num"] == num) & (x["type"] == BYTES))

    @batched(f"array<struct<key:{FIELD},value:{FIELD}>>")
    def entries(values: pd.Series) -> pd.Series:
        def one(bodies):
            out = []
            for b in bodies:
                found = {x[0]: _row(x) for x in fields(bytes(b))}
                out.append({"key": found.get(1), "value": found.get(2)})
            return out

        return values.map(lambda v: None if v is None else one(v))

    return entries(F.transform(hits, lambda x: x["data"]))


@batched("array<struct<path:string,depth:int,type:int,raw:decimal(20,0),data:binary>>")
def walk(values: pd.Series) -> pd.Series:
    """All fields depth first; bytes that read as a message are entered, down to DEPTH and up to FIELDS fields."""

    def visit(b: bytes, path: str, depth: int, out: list) -> None:
        for num, kind, raw, data in fields(b):
            if len(out) >= FIELDS:
                raise ValueError("too many fields")
            own = f"{path}.{num}" if path else str(num)
            out.append({"path": own, "depth": depth, "type": kind, "raw": Decimal(raw), "data": data})
            if kind == BYTES and data and depth < DEPTH:
                inner: list = []
                try:
                    visit(data, own, depth + 1, inner)
                except ValueError:
                    continue
                out += inner

    def one(b: bytes) -> list:
        out: list = []
        visit(b, "", 0, out)
        return out

    return values.map(_safe(one))


def unpack_struct(b: Column, layout: dict[str, str], order: str = "<", repeated: bool = False) -> Column:
    """Fixed-layout decoding: names to struct format characters; repeated: an array of as many as fit exactly."""
    kinds = {"b": "int", "B": "int", "h": "int", "H": "int", "i": "bigint", "I": "bigint", "q": "bigint", "Q": "decimal(20,0)", "f": "double", "d": "double", "?": "boolean"}
    form = order + "".join(layout.values())
    shape = "struct<" + ",".join(f"`{n}`:{kinds[c]}" for n, c in layout.items()) + ">"

    def row(values: tuple) -> dict:
        return {n: Decimal(v) if c == "Q" else v for (n, c), v in zip(layout.items(), values, strict=True)}

    @batched(f"array<{shape}>")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(_safe(lambda x: [row(v) for v in struct.iter_unpack(form, x)]))

    return decoded(b) if repeated else F.get(decoded(F.substring(b, 1, struct.calcsize(form))), F.lit(0))


def pack_struct(columns: list[Column], formats: str, order: str = "<") -> Column:
    """Fixed-layout encoding of columns; a null among them gives null."""

    @batched("binary")
    def encoded(rows: pd.DataFrame) -> pd.Series:
        def one(r):
            if any(x is None or x != x for x in r):
                return None
            return struct.pack(order + formats, *[float(x) if c in "fd" else int(x) for x, c in zip(r, formats, strict=True)])

        return pd.Series([one(r) for r in rows.itertuples(index=False)], index=rows.index)

    return encoded(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))
