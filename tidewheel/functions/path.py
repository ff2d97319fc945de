"""Lexical paths with / or \\ between segments, and file URIs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.url import path_escape, path_unescape

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"


def scheme(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, SCHEME, 1))


def authority(p: Column) -> Column:
    return F.regexp_extract(p, r"^[^:]*://([^/\\]*)", 1)


def _bare(p: Column) -> Column:
    return F.regexp_replace(p, SCHEME, "")


def is_absolute(p: Column) -> Column:
    return p.rlike(SCHEME) | p.rlike(r"^(/|\\\\|[A-Za-z]:[/\\])")


def base(p: Column) -> Column:
    """The last segment; '.' for an empty path, '/' for a root."""
    name = F.regexp_extract(_bare(p), r"([^/\\]+)[/\\]*$", 1)
    return F.when(p == "", ".").when(name == "", "/").otherwise(name)


def ext(p: Column) -> Column:
    """From the last dot of the last segment; a leading dot is none."""
    return F.regexp_extract(base(p), r"^.+?(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    b, e = base(p), ext(p)
    return F.substring(b, F.lit(1), F.length(b) - F.length(e))


def dir_(p: Column) -> Column:
    """The path without its last segment; '.' if there is only one."""
    trimmed = F.regexp_replace(p, r"[/\\]+$", "")
    head = F.regexp_extract(trimmed, r"^(.*)[/\\][^/\\]*$", 1)
    has = trimmed.rlike(r"[/\\]")
    local = F.when(trimmed == "", "/").when(~has, ".").when(head == "", "/").otherwise(head)
    rest = F.regexp_replace(trimmed, SCHEME, "")
    url = F.when(rest.rlike(r"[/\\]"), head).otherwise(p)
    return F.when(p == "", ".").when(p.rlike(SCHEME), url).otherwise(local)


def segments(p: Column) -> Column:
    """The segments, without scheme and authority and empty ones."""
    rest = F.when(p.rlike(SCHEME), F.regexp_replace(p, r"^[^:]*://[^/\\]*", "")).otherwise(p)
    return F.filter(F.split(rest, r"[/\\]"), lambda s: s != "")


def ancestors(p: Column) -> Column:
    """The parents of a local path from the nearest to the root."""
    s = segments(p)
    lead = F.when(p.startswith("/"), "/").otherwise("")
    up = F.transform(F.when(F.size(s) > 1, F.sequence(F.size(s) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: F.concat(lead, F.array_join(F.slice(s, F.lit(1), n), "/")))
    return F.concat(up, F.when(p.startswith("/") & (F.size(s) > 0), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))


def join(p: Column, *more: Column) -> Column:
    """Segments joined by one /; empty ones are skipped."""
    parts = [F.regexp_replace(p, r"[/\\]+$", ""), *[F.regexp_replace(m, r"^[/\\]+|[/\\]+$", "") for m in more]]
    first, rest = parts[0], F.array_join(F.filter(F.array(*parts[1:]), lambda s: s != ""), "/")
    lead = F.when(p.rlike(r"^[/\\]+$"), "/").when(first == "", "").otherwise(F.concat(first, F.lit("/")))
    return F.when(rest == "", F.when(p.rlike(r"^[/\\]+$"), "/").otherwise(first)).otherwise(F.concat(lead, rest))


def with_ext(p: Column, new: str) -> Column:
    e = ext(p)
    return F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(e)), F.lit(new if not new or new.startswith(".") else "." + new))


def has_prefix(p: Column, q: Column) -> Column:
    """Does q lead p by whole segments?"""
    return F.slice(segments(p), F.lit(1), F.size(segments(q))) == segments(q)


def relative(p: Column, to: Column) -> Column:
    """The way from `to` to p, with .. for each step up."""
    a, b = segments(p), segments(to)
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(acc))
    up = F.array_repeat(F.lit(".."), F.size(b) - same)
    out = F.array_join(F.concat(up, F.slice(a, same + 1, F.size(a))), "/")
    return F.when(out == "", ".").otherwise(out)


def clean(p: Column) -> Column:
    """Without . and empty segments, each .. taking one away; an absolute path never leaves its root."""
    rooted = p.startswith("/")

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        lost = (s == "..") & rooted & (F.size(acc) == 0)
        return F.when((s == ".") | lost, acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    kept = F.array_join(F.aggregate(segments(p), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), kept)).when(kept == "", ".").otherwise(kept)


def sanitize(p: Column) -> Column:
    """A clean relative path: no drive letter, no leading slash, no way up."""
    rel = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "^[A-Za-z]:", "")
    return F.regexp_replace(clean(F.concat(F.lit("/"), rel)), "^/", "")


def join_url(url: Column, *parts: Column) -> Column:
    """Parts joined to a url's path, with . and .. resolved."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    return F.concat(head, clean(F.concat_ws("/", F.concat(F.lit("/"), rest), *parts)))


def to_uri(p: Column) -> Column:
    """A POSIX path as file URI."""
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(p, "/"), path_escape), "/"))


def from_uri(u: Column) -> Column:
    """The path of a file URI, null for another scheme."""
    return F.when(u.rlike("(?i)^file://"), path_unescape(F.regexp_replace(u, "(?i)^file://(localhost)?", "")))


def glob(p: Column, pattern: str) -> Column:
    """Does a shell pattern (* ? [a-z] [^a] and \\ escapes) fit the last segment?"""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += r"[^/]*"
        elif c == "?":
            out += r"[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            out += pattern[i : end + 1]
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return base(p).rlike(f"^{out}$")


def resolve_under(base: Column, ref: Column) -> Column:
    """A reference under a base url whose path stays as a prefix; absolute urls and those that begin with // go by themselves.

    Paths are joined and cleaned of dot segments unless the base's is empty or /; a last slash of the reference
    stays. The queries of both follow each other, the reference's fragment goes before the base's. An empty reference
    is the base; a base without a host leaves the reference as it is."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    scheme, host, path, query, fragment = (F.regexp_extract(base, pattern, i) for i in range(1, 6))
    rel, rel_query, rel_fragment = (F.regexp_extract(ref, r"^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i) for i in (1, 2, 3))
    bare, clean_rel = F.regexp_replace(path, "/$", ""), F.regexp_replace(rel, "^/", "")
    joined = clean(F.concat(bare, F.lit("/"), clean_rel))
    joined = F.when(rel.endswith("/") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    rooted = F.when(rel.startswith("/"), rel).otherwise(F.concat(F.lit("/"), rel))
    full = F.when(rel == "", path).when(path.isin("", "/"), rooted).when(clean_rel == "", F.concat(bare, F.lit("/"))).otherwise(joined)
    asked = F.when((query != "") & (rel_query != ""), F.concat(query, F.lit("&"), rel_query)).otherwise(F.concat(query, rel_query))
    mark = F.when(rel_fragment != "", rel_fragment).otherwise(fragment)
    out = F.concat(scheme, host, full, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""), F.when(mark != "", F.concat(F.lit("#"), mark)).otherwise(""))
    absolute = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute | (F.length(host) <= 2), ref).when(ref == "", base).when(ref.startswith("//"), F.concat(scheme, ref)).otherwise(out)


def normal_base(base: Column) -> Column:
    """A base url that ends with a slash; '' stays."""
    return F.when((base == "") | base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
