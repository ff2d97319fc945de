"""Text functions: identifiers, ASCII folding, cutting, scanning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Extensions of files that don't compress further: fixed values.
INCOMPRESSIBLE = (
    "7z", "aac", "apk", "avi", "bz2", "docx", "eon", "flac", "gif", "gz", "iso", "jar", "jpeg", "jpg", "mkv", "mov", "mp3", "mp4",
    "ogg", "pdf", "png", "pptx", "rar", "tgz", "webm", "webp", "xlsx", "xz", "zip", "zst",
)


def split_words(s: Column) -> Column:
    """Words of an identifier: cut at _ - space . / and where lower case or an acronym meets a capitalised word."""
    cut = F.regexp_replace(F.regexp_replace(s, r"([^\p{Lu}_\-. /])(\p{Lu})", "$1_$2"), r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1_")
    return F.filter(F.split(cut, r"[_\-. /]"), lambda w: w != "")


def snake(s: Column) -> Column:
    return F.lower(F.array_join(split_words(s), "_"))


def kebab(s: Column) -> Column:
    return F.lower(F.array_join(split_words(s), "-"))


def screaming(s: Column) -> Column:
    return F.upper(F.array_join(split_words(s), "_"))


def _title(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def pascal(s: Column) -> Column:
    return F.array_join(F.transform(split_words(s), _title), "")


def camel(s: Column) -> Column:
    return F.array_join(F.transform(split_words(s), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_title(w))), "")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def equal_fold(a: Column, b: Column) -> Column:
    """Equality but for the case of ASCII letters."""
    return ascii_lower(a) == ascii_lower(b)


def contains_fold(s: Column, part: Column) -> Column:
    return F.contains(ascii_lower(s), ascii_lower(part))


def trim_quotes(s: Column) -> Column:
    """Without one enclosing pair of double quotes."""
    return F.regexp_replace(s, '(?s)^"(.*)"$', "$1")


def trim_space(s: Column) -> Column:
    """Without spaces, tabs, line feeds and carriage returns at both ends."""
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def cut(s: Column, sep: str) -> Column:
    """A struct of before, after and found for the first separator; not found: before is everything."""
    at = F.instr(s, sep)
    before = F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s)
    after = F.when(at > 0, F.substring(s, at + len(sep), F.length(s))).otherwise("")
    return F.struct(before.alias("before"), after.alias("after"), (at > 0).alias("found"))


def scan_tokens(s: Column, delimiter: str = ",") -> Column:
    """Parts between delimiters outside double quotes, trimmed, without empty ones; an open quote runs to the end."""
    d = "\\" + delimiter
    found = F.regexp_extract_all(s, F.lit(f'((?:[^{d}"]|"[^"]*(?:"|$))+)'), F.lit(1))
    return F.filter(F.transform(found, trim_space), lambda t: t != "")


def scan_pairs(s: Column, entry: str = ";", sign: str = "=") -> Column:
    """An array of (k, v) in order, repeats kept, both trimmed; without the sign v is empty."""

    def pair(t: Column) -> Column:
        c = cut(t, sign)
        return F.struct(trim_space(c["before"]).alias("k"), trim_space(c["after"]).alias("v"))

    return F.transform(scan_tokens(s, entry), pair)


def slice_once(s: Column, pattern: str, offset: int) -> Column:
    """[head, tail], cut `offset` characters after the start of the first match; the pattern stays; no match: [s]."""
    at = F.instr(s, pattern) - 1 + offset
    whole = (F.instr(s, pattern) == 0) | (at <= 0) | (at >= F.length(s))
    return F.when(whole, F.array(s)).otherwise(F.array(F.substring(s, F.lit(1), at), F.substring(s, at + 1, F.length(s))))


def slice_all(s: Column, pattern: str) -> Column:
    """All parts, each ending with the pattern it was cut after, and what remains."""
    import re

    own = re.escape(pattern)
    return F.filter(F.regexp_extract_all(s, F.lit(f"(?s)(.*?{own}|.+$)"), F.lit(1)), lambda t: t != "")


def parse_uint(s: Column) -> Column:
    """An unsigned 64-bit decimal as decimal(20,0); null for anything else."""
    v = s.try_cast("decimal(38,0)")
    return F.when(s.rlike("^[0-9]{1,30}$") & (v <= F.lit("18446744073709551615").cast("decimal(38,0)")), v.cast("decimal(20,0)"))


def format_number(x: Column) -> Column:
    """A number as text: whole doubles without a fraction."""
    return F.when(x == F.floor(x), F.format_string("%.0f", x.cast("double"))).otherwise(x.cast("string"))


def index_of(s: Column, part: str) -> Column:
    """The first position from 0, -1 if there is none."""
    return F.instr(s, part) - 1


def index_of_two(s: Column, a: str, b: str) -> Column:
    """The first position of either."""
    i, j = (F.nullif(index_of(s, x), F.lit(-1)) for x in (a, b))
    return F.coalesce(F.least(i, j), i, j, F.lit(-1))


def match_head(s: Column, target: str, width: int) -> Column:
    """Do the first `width` bytes equal the target's? Shorter text or target: false."""
    b = s.cast("binary")
    t = target.encode()
    if len(t) < width:
        return F.lit(False)
    return (F.octet_length(s) >= width) & (F.substring(b, 1, width) == F.lit(bytearray(t[:width])))


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts have in common at the start, found by halving; as many steps as the shorter length has bits."""
    n = F.least(F.length(a), F.length(b))

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(mid - 1).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), half, lambda acc: acc["lo"])


def html_escape(s: Column) -> Column:
    """JSON-safe forms of < > & and the two Unicode line ends."""
    for c in "<>&\u2028\u2029":
        s = F.replace(s, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return s


def remove_class(s: Column, chars: str) -> Column:
    """Without the characters of a regular expression's class."""
    return F.regexp_replace(s, f"[{chars}]", "")


def is_incompressible(ext: Column) -> Column:
    """Of an extension, with or without its dot; use file_extension() for a file name."""
    return ascii_lower(F.regexp_replace(ext, r"^\.", "")).isin(*INCOMPRESSIBLE)


def file_extension(name: Column) -> Column:
    """What follows the last dot of a file name, without the dot; '' if there is none."""
    return F.regexp_extract(name, r"\.([^./]*)$", 1)


def chain(s: Column, *steps) -> Column:
    """The steps, each from Column to Column, one after another."""
    for step in steps:
        s = step(s)
    return s


def strip_bom(s: Column) -> Column:
    return F.regexp_replace(s, "^\ufeff", "")


def parse_tag(s: Column) -> Column:
    """A tag `name,option,key=value`: struct of name, options and values (a map; the first of a repeated key)."""
    parts = F.transform(F.split(s, ","), trim_space)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.transform(F.filter(rest, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(cut(x, "=")["before"].alias("key"), cut(x, "=")["after"].alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    first = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(pairs, lambda p: p["key"] == k), 0)["value"].alias("value"))))
    return F.struct(F.get(parts, 0).alias("name"), F.filter(rest, lambda x: ~F.contains(x, F.lit("="))).alias("options"), first.alias("values"))
