"""DNS messages and service-binding records in Arrow-batched functions; malformed bytes give null."""

from __future__ import annotations

import ipaddress
import struct

import pandas as pd
from pyspark.sql import functions as F

from tidewheel.functions.batched import batched

#: Record types: fixed values.
A, CNAME, AAAA, SVCB, HTTPS = 1, 5, 28, 64, 65
#: Service parameter keys by number: fixed values.
PARAMETERS = {0: "mandatory", 1: "alpn", 2: "no-default-alpn", 3: "port", 4: "ipv4hint", 5: "ech", 6: "ipv6hint"}


def read_name(b: bytes, at: int) -> tuple[str, int]:
    """A name and the position after it; pointers only lead backwards."""
    labels, after, floor = [], None, at
    while True:
        n = b[at]
        if n >= 192:
            to = (n & 63) << 8 | b[at + 1]
            after = after if after is not None else at + 2
            if to >= floor:
                raise ValueError("pointer")
            at = floor = to
        elif n > 63:
            raise ValueError("label")
        elif n == 0:
            return ".".join(labels), after if after is not None else at + 1
        else:
            if at + 1 + n > len(b):
                raise ValueError("label")
            labels.append(b[at + 1 : at + 1 + n].decode("ascii"))
            at += 1 + n


def records(b: bytes) -> list[dict]:
    """The answers of a response: name, type, ttl, value (an address, a name or hexadecimal data)."""
    _, flags, questions, answers = struct.unpack(">4H", b[:8])
    if not flags & 0x8000:
        raise ValueError("not a response")
    at = 12
    for _ in range(questions):
        at = read_name(b, at)[1] + 4
    out = []
    for _ in range(answers):
        name, at = read_name(b, at)
        kind, _, ttl, size = struct.unpack(">HHIH", b[at : at + 10])
        at += 10
        data = b[at : at + size]
        if len(data) < size:
            raise ValueError("cut off")
        value = str(ipaddress.ip_address(data)) if kind in (A, AAAA) else read_name(b, at)[0] if kind == CNAME else data.hex()
        out.append({"name": name, "type": kind, "ttl": 0 if ttl >> 31 else min(ttl, 604800), "value": value})
        at += size
    return out


def service(b: bytes) -> dict:
    """Priority, target and parameters of a service binding; priority 0 is an alias."""
    (priority,) = struct.unpack(">H", b[:2])
    target, at = read_name(b, 2)
    found, last = {}, -1
    while at < len(b):
        key, size = struct.unpack(">HH", b[at : at + 4])
        data = b[at + 4 : at + 4 + size]
        if key <= last or len(data) < size:
            raise ValueError("parameters")
        last, at = key, at + 4 + size
        if key == 1:
            parts, k = [], 0
            while k < size:
                parts.append(data[k + 1 : k + 1 + data[k]].decode())
                k += 1 + data[k]
            value = ",".join(parts)
        elif key == 3:
            value = str(struct.unpack(">H", data)[0])
        elif key in (4, 6):
            width = 4 if key == 4 else 16
            value = ",".join(str(ipaddress.ip_address(data[k : k + width])) for k in range(0, size, width))
        elif key == 0:
            value = ",".join(PARAMETERS.get(x[0], f"key{x[0]}") for x in struct.iter_unpack(">H", data))
        else:
            value = data.hex()
        found[PARAMETERS.get(key, f"key{key}")] = value
    return {"priority": priority, "target": target, "parameters": found}


def _each(f):
    def one(b):
        try:
            return None if b is None else f(bytes(b))
        except (ValueError, IndexError, struct.error):
            return None

    return one


@batched("array<struct<name:string,type:int,ttl:bigint,value:string>>")
def answers(messages: pd.Series) -> pd.Series:
    return messages.map(_each(records))


@batched("struct<priority:int,target:string,parameters:map<string,string>>")
def service_binding(data: pd.Series) -> pd.DataFrame:
    none = {"priority": None, "target": None, "parameters": None}
    return pd.DataFrame([_each(service)(b) or none for b in data], columns=list(none), index=data.index)


@batched("binary")
def pack_query(names: pd.Series, ids: pd.Series, kinds: pd.Series) -> pd.Series:
    """A recursive query for a name; null for a name that has no wire form."""

    def one(name, number, kind):
        labels = [x.encode("ascii", "ignore") for x in (name or "").rstrip(".").split(".")]
        if not name or any(not 0 < len(x) < 64 for x in labels):
            return None
        return struct.pack(">6H", number, 0x0100, 1, 0, 0, 0) + b"".join(bytes([len(x)]) + x for x in labels) + b"\0" + struct.pack(">2H", kind, 1)

    return pd.Series([one(*x) for x in zip(names, ids, kinds, strict=True)], index=names.index)
