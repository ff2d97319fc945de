"""Hexadecimal, base 64, variable-length integers and fixed-width numbers in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.batched import batched


def hex_encode(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_decode(s: Column) -> Column:
    """Null for an odd length or another character."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def hex_number(x: Column) -> Column:
    return F.lower(F.hex(x))


def parse_hex(s: Column) -> Column:
    """Up to 16 digits as an unsigned 64-bit number, decimal(20,0); null for anything else."""
    return F.when(s.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(s, 16, 10).cast("decimal(20,0)"))


def base64_url(b: Column) -> Column:
    """URL-safe alphabet, no padding."""
    return F.regexp_replace(F.translate(F.base64(b), "+/", "-_"), "=+$", "")


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("bigint"))))


def quic_length(x: Column) -> Column:
    """Bytes of a number with a two-bit length prefix."""
    return F.when(x <= 63, 1).when(x <= 16383, 2).when(x <= 1073741823, 4).otherwise(8)


def _bytes(x: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(x), 2 * n, "0"))


def quic_encode(x: Column) -> Column:
    """A non-negative number below 2**62 with a two-bit length prefix."""
    out = F.lit(None).cast("binary")
    for n, limit, mark in ((8, (1 << 62) - 1, 3 << 62), (4, 1073741823, 2 << 30), (2, 16383, 1 << 14), (1, 63, 0)):
        mark = mark - (1 << 64) if mark >= 1 << 63 else mark
        out = F.when((x >= 0) & (x <= limit), _bytes(x.bitwiseOR(F.lit(mark).cast("bigint")), n)).otherwise(out)
    return out


def load_be(b: Column, at: int, n: int) -> Column:
    """n bytes from position `at` (from 0), most significant first, as a number; n is at most 7."""
    return F.when(F.octet_length(b) >= at + n, F.conv(F.hex(F.substring(b, at + 1, n)), 16, 10).cast("bigint"))


def load_le(b: Column, at: int, n: int) -> Column:
    """As load_be, least significant first."""
    value = F.lit(0).cast("bigint")
    for i in range(n):
        value = value + F.shiftleft(load_be(b, at + i, 1), 8 * i)
    return value


def store_be(x: Column, n: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(x), 16, "0"), 17 - 2 * n, 2 * n))


def store_le(x: Column, n: int) -> Column:
    return F.concat(*[F.substring(store_be(x, n), n - i, 1) for i in range(n)])


def load_u64(b: Column, at: int, little: bool = False) -> Column:
    """Eight bytes from position `at` as an unsigned number, decimal(20,0); null if they aren't all there."""
    part = F.substring(b, at + 1, 8)
    h = F.hex(part)
    if little:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.when(F.octet_length(b) >= at + 8, F.conv(h, 16, 10).cast("decimal(20,0)"))


def unsigned(x: Column) -> Column:
    """Two's complement as an unsigned 64-bit number, decimal(20,0)."""
    return (x.cast("decimal(20,0)") + F.when(x < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)")


def _octets(b: Column, at: int) -> Column:
    """Up to eight bytes from position `at`, followed by zeros, as one bigint in two's complement."""
    return F.conv(F.rpad(F.hex(F.substring(b, at + 1, 8)), 16, "0"), 16, -10).cast("bigint")


def _octet(word: Column, i: int) -> Column:
    return F.shiftrightunsigned(word, 56 - 8 * i).bitwiseAND(F.lit(255).cast("bigint"))


def quic_decode(b: Column) -> Column:
    """value and size of the number at the start of a binary, null if it is cut off; values of 8 bytes keep 62 bits."""
    word = _octets(b, 0)
    kind = F.shiftrightunsigned(word, 62)
    n = F.when(kind == 0, 1).when(kind == 1, 2).when(kind == 2, 4).otherwise(8)
    low = word.bitwiseAND(F.lit((1 << 62) - 1).cast("bigint"))
    value = F.when(kind == 0, F.shiftrightunsigned(low, 56)).when(kind == 1, F.shiftrightunsigned(low, 48)).when(kind == 2, F.shiftrightunsigned(low, 32)).otherwise(low)
    return F.when((F.octet_length(b) > 0) & (F.octet_length(b) >= n), F.struct(value.alias("value"), n.alias("size")))


def quic_encode_all(x: Column) -> Column:
    """Any number of 64 bits: below 2**62 as quic_encode() has it; beyond, and below 0, its low 62 bits and then its two
    top bits, as two numbers."""
    low, top = x.bitwiseAND(F.lit((1 << 62) - 1).cast("bigint")), F.shiftrightunsigned(x, 62)
    return F.when(top == 0, quic_encode(x)).otherwise(F.concat(quic_encode(low), quic_encode(top)))


def quic_decode_all(b: Column) -> Column:
    """What quic_encode_all() encoded."""
    first = quic_decode(b)
    rest = F.substring(b, first["size"] + 1, F.lit(8))
    return F.when(F.octet_length(b) > first["size"], first["value"].bitwiseOR(F.shiftleft(quic_decode(rest)["value"], 62))).otherwise(first["value"])


@batched("struct<values:array<bigint>,rest:int>")
def quic_sequence(binaries):
    """All numbers of a binary one after another, and how many bytes of a last one that is cut off remain."""
    import pandas as pd

    def one(b: bytes | None):
        if b is None:
            return None, None
        found, at = [], 0
        while at < len(b) and at + (n := 1 << (b[at] >> 6)) <= len(b):
            found.append(int.from_bytes(b[at : at + n], "big") & ((1 << 8 * n - 2) - 1))
            at += n
        return found, len(b) - at

    return pd.DataFrame([one(b) for b in binaries], columns=["values", "rest"])


def uvarint_length(x: Column) -> Column:
    """Bytes in base 128 of a number taken as unsigned: two's complement below 0 has 10."""
    out = F.when(x < 0, 10)
    for n in range(1, 9):
        out = out.when(x < (1 << 7 * n), n)
    return out.otherwise(9)


def uvarint_encode(x: Column) -> Column:
    """A number taken as unsigned in base 128, least significant first."""
    n, digits = uvarint_length(x), []
    for i in range(10):
        seven = F.shiftrightunsigned(x, 7 * i).bitwiseAND(F.lit(127).cast("bigint"))
        digits.append(F.when(n > i + 1, F.hex(seven + 128)).when(n == i + 1, F.lpad(F.hex(seven), 2, "0")).otherwise(""))
    return F.unhex(F.concat(*digits))


def uvarint_decode(b: Column) -> Column:
    """value and size of the base-128 number at the start of a binary; values of 2**63 and more as two's complement
    (see unsigned()); null if it is cut off, has over 10 bytes or over 64 bits."""
    first, more = _octets(b, 0), _octets(b, 8)
    octets = [*[_octet(first, i) for i in range(8)], _octet(more, 0), _octet(more, 1)]
    size, value = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    total, found = F.lit(0).cast("bigint"), []
    for i, o in enumerate(octets):
        total = total.bitwiseOR(F.shiftleft(o.bitwiseAND(F.lit(127).cast("bigint")), 7 * i))
        found.append((o <= (1 if i == 9 else 127), i + 1, total))
    for ends, n, all_bits in reversed(found):
        size, value = F.when(ends, n).otherwise(size), F.when(ends, all_bits).otherwise(value)
    return F.when(size <= F.octet_length(b), F.struct(value.alias("value"), size.alias("size")))


def wire_tag(field: Column, kind: Column) -> Column:
    return F.shiftleft(field, 3).bitwiseOR(kind)


def fingerprint_hex(b: Column) -> Column:
    """SHA-256 as hexadecimal pairs between colons."""
    return F.regexp_replace(F.sha2(b, 256), "(..)(?=.)", "$1:")


def fingerprint_base64(b: Column) -> Column:
    return F.concat(F.lit("SHA256:"), F.regexp_replace(F.base64(F.unhex(F.sha2(b, 256))), "=+$", ""))


@batched("bigint")
def fnv_words(values):
    """A 64-bit FNV-1a over little-endian words of 8 bytes and then single bytes, as a signed number."""

    def one(b: bytes | None) -> int | None:
        if b is None:
            return None
        h, k = 14695981039346656037, len(b) - len(b) % 8
        for i in range(0, k, 8):
            h = (h ^ int.from_bytes(b[i : i + 8], "little")) * 1099511628211 % (1 << 64)
        for x in b[k:]:
            h = (h ^ x) * 1099511628211 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    return values.map(one)


@batched("binary")
def xor_mask(values, masks):
    """Every byte XORed with the four bytes of a mask (little-endian), again and again."""
    import numpy as np

    def one(b: bytes | None, m: int) -> bytes | None:
        if b is None:
            return None
        key = np.frombuffer(int(m).to_bytes(4, "little"), np.uint8)
        return (np.frombuffer(b, np.uint8) ^ np.resize(key, len(b))).tobytes()

    return values.combine(masks, one)


def gather_bits(x: Column, mask: int) -> Column:
    """The bits of x under a mask, packed to the low end."""
    out, k = F.lit(0).cast("bigint"), 0
    for i in range(64):
        if mask >> i & 1:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, i).bitwiseAND(F.lit(1).cast("bigint")), k))
            k += 1
    return out


def spread_bits(x: Column, mask: int) -> Column:
    """The low bits of x, spread to the places of a mask."""
    out, k = F.lit(0).cast("bigint"), 0
    for i in range(64):
        if mask >> i & 1:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1).cast("bigint")), i))
            k += 1
    return out
