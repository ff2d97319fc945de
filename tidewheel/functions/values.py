"""Zero values, lenient numbers, value-or-error, time texts, identifiers and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.batched import batched

RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def coalesce_zero(zero, *values: Column) -> Column:
    """The first value that is neither null nor the zero value; else the zero value."""
    return F.coalesce(*[F.nullif(v, F.lit(zero)) for v in values], F.lit(zero))


def result(value: Column, error: str) -> Column:
    """A struct of value and error: error is null where there is a value."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit(error)).alias("error"))


def recovered(r: Column, other: Column) -> Column:
    return F.struct(F.coalesce(r["value"], other).alias("value"), F.lit(None).cast("string").alias("error"))


def either(is_right: Column, left: Column, right: Column) -> Column:
    """A tagged union: tag, left, right."""
    return F.struct(F.when(is_right, "right").otherwise("left").alias("tag"), F.when(~is_right, left).alias("left"), F.when(is_right, right).alias("right"))


def either_fold(e: Column, on_left, on_right) -> Column:
    return F.when(e["tag"] == "left", on_left(e["left"])).otherwise(on_right(e["right"]))


def either_swap(e: Column) -> Column:
    return F.struct(F.when(e["tag"] == "left", "right").otherwise("left").alias("tag"), e["right"].alias("left"), e["left"].alias("right"))


def unquoted(s: Column) -> Column:
    return F.regexp_replace(s, '^"(.*)"$', "$1")


def lenient(s: Column, kind: str) -> Column:
    """A number or a quoted one; '' and null and the text null: 0; anything else: null. Unsigned 64 bits: decimal(20,0)."""
    v = unquoted(s)
    return F.when(s.isNull() | v.isin("", "null"), F.lit(0).cast(kind)).otherwise(v.try_cast(kind))


def bool_int(s: Column) -> Column:
    """true, and whole numbers but 0: true; all else: false."""
    v = unquoted(s)
    return F.coalesce((F.lower(v) == "true") | (v.try_cast("bigint") != 0), F.lit(False))


def quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x.cast("string"), F.lit('"'))


def format_rfc3339(ts: Column) -> Column:
    """UTC, whole seconds; the session's zone should be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(s: Column) -> Column:
    """Strict layout with a zone; second 60 counts as 59; null for anything else."""
    part = [F.regexp_extract(s, RFC3339, i) for i in range(1, 6)]
    second = F.when(part[2] == "60", "59").otherwise(part[2])
    zone = F.when(F.upper(part[4]) == "Z", "+00:00").otherwise(part[4])
    text = F.concat(part[0], F.lit("T"), part[1], F.lit(":"), second, F.substring(part[3], 1, 7), zone)
    return F.when(s.rlike(RFC3339), text.try_cast("timestamp"))


def format_http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def parse_http_date(s: Column) -> Column:
    """The weekday isn't tested against the date; second 60 is the next minute's first."""
    pattern = r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}):(\d{2}) GMT$"
    minute = F.try_to_timestamp(F.regexp_extract(s, pattern, 1), F.lit("dd MMM yyyy HH:mm"))
    second = F.regexp_extract(s, pattern, 2).try_cast("int")
    return F.when(s.rlike(pattern) & (second <= 60), F.timestamp_micros(F.unix_micros(minute) + second.cast("bigint") * 1_000_000))


def epoch_timestamp(s: Column) -> Column:
    """Seconds since 1970, plain or quoted; 0, '' and null: null."""
    return F.timestamp_seconds(F.nullif(unquoted(s).try_cast("bigint"), F.lit(0).cast("bigint")))


def time_range(start: Column, end: Column, interval: str) -> Column:
    """The instants from start to end, both included."""
    return F.sequence(start, end, F.expr(f"INTERVAL {interval}"))


def normal_ttl(t: Column) -> Column:
    """0 where bit 31 is set, else at most a week of seconds."""
    return F.when(t.bitwiseAND(F.lit(2147483648)) != 0, F.lit(0).cast("bigint")).otherwise(F.least(t, F.lit(604800).cast("bigint")))


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")


def uuid_version(s: Column) -> Column:
    return F.when(is_uuid(s), F.conv(F.substring(s, 15, 1), 16, 10).cast("int"))


def uuid_variant(s: Column) -> Column:
    """ncs, rfc4122, microsoft or future, by the first bits of the ninth byte."""
    n = F.conv(F.substring(s, 20, 1), 16, 10).cast("int")
    return F.when(is_uuid(s), F.when(n < 8, "ncs").when(n < 12, "rfc4122").when(n < 14, "microsoft").otherwise("future"))


def uuid_time(s: Column) -> Column:
    """The time of a version 7 identifier, null for others."""
    millis = F.conv(F.concat(F.substring(s, 1, 8), F.substring(s, 10, 4)), 16, 10).cast("bigint")
    return F.when(uuid_version(s) == 7, F.timestamp_millis(millis))


def uuid_v7_wide(millis: Column) -> Column:
    """A version 7 identifier of any number of milliseconds: the 16 bits that its 48 of time don't hold begin its last
    group, which the format leaves free. For a given time always the same one."""
    h = F.lpad(F.lower(F.hex(millis)), 16, "0")
    return F.concat(F.substring(h, 5, 8), F.lit("-"), F.substring(h, 13, 4), F.lit("-7abc-9def-"), F.substring(h, 1, 4), F.lit("456789ab"))


def uuid_wide_millis(s: Column) -> Column:
    """The milliseconds of an identifier of uuid_v7_wide()."""
    top = F.conv(F.substring(s, 25, 4), 16, 10).cast("bigint")
    return F.shiftleft(top, 48).bitwiseOR(F.unix_millis(uuid_time(s)))


def uuid_v7(millis: Column) -> Column:
    """A version 7 identifier of that time; the rest is random."""
    h = F.concat(F.lpad(F.lower(F.hex(millis)), 12, "0"), F.lit("7"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 3), F.lit("a"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 16, 15))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def json_entries(s: Column) -> Column:
    """A map of keys to values as text; of a repeated key the last (json_pairs() keeps all); null for what is no object."""
    return F.from_json(s, "map<string,string>")


def json_elements(s: Column) -> Column:
    return F.from_json(s, "array<string>")


def json_typed(s: Column, schema: str, keys: list[str]) -> Column:
    """Typed decoding whose field names match without regard to case."""
    for k in keys:
        s = F.regexp_replace(s, f'(?i)"{k}"(\\s*:)', f'"{k}"$1')
    return F.from_json(s, schema)


@batched("array<struct<key:string,value:string>>")
def json_pairs(texts):
    """The entries of an object in order, repeated keys included, values as they are spelt; those before a fault; none for what is no object. Null: null."""
    import json

    reader, white = json.JSONDecoder(), " \t\r\n"

    def past(s: str, at: int) -> int:
        while at < len(s) and s[at] in white:
            at += 1
        return at

    def one(s: str | None):
        if s is None:
            return None
        out, at = [], past(s, 0)
        if s[at : at + 1] != "{":
            return out
        at = past(s, at + 1)
        try:
            while s[at] == '"':
                key, at = reader.raw_decode(s, at)
                at = past(s, at)
                if s[at] != ":":
                    return out
                begin = past(s, at + 1)
                _, end = reader.raw_decode(s, begin)
                out.append({"key": key, "value": s[begin:end]})
                at = past(s, end)
                if s[at] != ",":
                    return out
                at = past(s, at + 1)
        except (ValueError, IndexError, RecursionError):
            pass
        return out

    return texts.map(one)


def json_marshalled(fields: dict[str, Column], pretty: bool = False) -> Column:
    """An object of these fields, those that are null left out, with < > & and the two Unicode line ends escaped."""
    from tidewheel.functions.text import html_escape

    return html_escape(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"pretty": "true" if pretty else "false"}))


@batched("string")
def _indented(texts, indents):
    import json

    def one(s: str | None, indent: str) -> str | None:
        try:
            return json.dumps(json.loads(s, object_pairs_hook=lambda x: dict(x)), indent=indent, ensure_ascii=False, separators=(",", ": "))
        except (TypeError, ValueError):
            return None

    return texts.combine(indents, one)


def json_indented(s: Column, indent: str = "  ") -> Column:
    """One entry or element a line, each level further in; null for invalid JSON."""
    return _indented(s, F.lit(indent))


def json_strict(s: Column, schema: str, names: list[str]) -> Column:
    """Typed decoding that gives null for an object with a key that is none of `names`."""
    known = F.forall(F.json_object_keys(s), lambda k: F.lower(k).isin(*[n.lower() for n in names]))
    return F.when(known, json_typed(s, schema, names))


def same_type(a: Column, b: Column) -> Column:
    return F.typeof(a) == F.typeof(b)


def is_numeric(x: Column) -> Column:
    return F.typeof(x).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")


def as_int64(x: Column) -> Column:
    """A value as bigint; null where it isn't a whole number or doesn't fit."""
    n = x.try_cast("bigint")
    return F.when(x.try_cast("decimal(38,10)") == n.cast("decimal(38,10)"), n)


def type_name(df_schema: T.StructType, path: str) -> str:
    """The type of a field at a dotted path, arrays and maps looked through to their values."""
    kind: T.DataType = df_schema
    for part in path.split("."):
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        kind = kind[part].dataType
    return kind.simpleString()


def sealed(plain: Column, key: Column, nonce: Column, extra: str = "") -> Column:
    """AES-GCM: the nonce of 12 bytes, the ciphertext and the tag."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("NONE"), nonce, F.lit(extra))


def opened(sealed_: Column, key: Column, extra: str = "") -> Column:
    """What sealed() sealed; null if the key, the extra data or a bit is wrong."""
    return F.try_aes_decrypt(sealed_, key, F.lit("GCM"), F.lit("NONE"), F.lit(extra))


def clipped(body: Column, length: Column) -> Column:
    """At most `length` bytes of a body; a negative length is no bound."""
    return F.when(length < 0, body).otherwise(F.substring(body, F.lit(1), length.cast("int")))


def uuid_format(b: Column) -> Column:
    """The text of 16 bytes; null for another length."""
    h = F.lower(F.hex(b))
    return F.when(F.octet_length(b) == 16, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))


def uuid_bytes(s: Column) -> Column:
    """The 16 bytes of an identifier's text; null for what is none."""
    return F.when(is_uuid(s), F.unhex(F.replace(s, F.lit("-"), F.lit(""))))


@batched("boolean")
def json_valid(texts):
    """Is the text one JSON value and nothing else? Null: null."""
    import json

    def strict(x):
        raise ValueError(x)

    def one(s: str | None) -> bool | None:
        try:
            json.loads(s, parse_constant=strict)
        except (ValueError, RecursionError):
            return False
        except TypeError:
            return None
        return True

    return texts.map(one)


@batched("string")
def json_compact(texts):
    """Without white space between tokens; order and spelling stay. Null for invalid JSON."""
    import json
    import re

    token = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s"]+')

    def one(s: str | None) -> str | None:
        try:
            json.loads(s)
        except (TypeError, ValueError):
            return None
        return "".join(token.findall(s))

    return texts.map(one)


def visible_fields(schema: T.StructType) -> list[str]:
    """Field names with those of nested structs lifted up; an outer field hides an inner one of its name."""
    outer = [f.name for f in schema if not isinstance(f.dataType, T.StructType)]
    inner = [n for f in schema if isinstance(f.dataType, T.StructType) for n in visible_fields(f.dataType)]
    return [*outer, *[n for n in dict.fromkeys(inner) if n not in outer and inner.count(n) == 1]]
