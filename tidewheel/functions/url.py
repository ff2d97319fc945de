"""URLs, hosts and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.batched import batched
from tidewheel.functions.text import ascii_lower, equal_fold

#: scheme, user, host, path, query, fragment
VIEW = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:([^/?#]*)@)?([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
FIELDS = ("scheme", "user", "host", "path", "query", "fragment")


def view(url: Column) -> Column:
    """A struct of the six parts, '' where one is absent, the scheme in lower case; null for a url with a NUL or a blank or angle bracket in its host."""
    parts = {f: F.regexp_extract(url, VIEW, i + 1) for i, f in enumerate(FIELDS)}
    parts["scheme"] = ascii_lower(parts["scheme"])
    bad = F.contains(url, F.lit("\0")) | parts["host"].rlike(r"[\s<>]")
    return F.when(~bad, F.struct(*[v.alias(k) for k, v in parts.items()]))


def build(v: Column) -> Column:
    """A url from a view; empty parts go, but // stays for http and https."""
    user = F.when(v["user"] != "", F.concat(v["user"], F.lit("@"))).otherwise("")
    host = F.when((v["host"] != "") | v["scheme"].isin("http", "https"), F.concat(F.lit("//"), user, v["host"])).otherwise("")
    return F.concat(
        F.when(v["scheme"] != "", F.concat(v["scheme"], F.lit(":"))).otherwise(""), host, v["path"],
        F.when(v["query"] != "", F.concat(F.lit("?"), v["query"])).otherwise(""), F.when(v["fragment"] != "", F.concat(F.lit("#"), v["fragment"])).otherwise(""),
    )


def hostname(host: Column) -> Column:
    """Without the port; a bracketed address without brackets and with its zone's %25 as %."""
    inner = F.regexp_replace(F.regexp_extract(host, r"^\[([^\]]*)\]", 1), "%25", "%")
    one = F.length(host) - F.length(F.replace(host, F.lit(":"), F.lit(""))) == 1
    return F.when(host.rlike(r"^\[[^\]]*\]"), inner).when(~host.startswith("[") & one, F.substring_index(host, ":", 1)).otherwise(host)


def port(host: Column) -> Column:
    rest = F.when(host.startswith("["), F.regexp_extract(host, r"^\[[^\]]*\](.*)$", 1)).otherwise(host)
    one = F.length(rest) - F.length(F.replace(rest, F.lit(":"), F.lit(""))) == 1
    return F.when(one, F.substring_index(rest, ":", -1)).otherwise("")


def canonical_port(scheme: Column, host: Column) -> Column:
    return F.when(port(host) != "", port(host)).when(ascii_lower(scheme) == "https", "443").when(ascii_lower(scheme) == "http", "80").otherwise("")


def is_absolute(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def decoded(s: Column) -> Column:
    """Percent-decoded in query mode; text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(s), s)


def query_pairs(query: Column) -> Column:
    """An array of (k, v) in order, decoded, repeats kept; without = the value is ''."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        k = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        v = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise("")
        return F.struct(decoded(k).alias("k"), decoded(v).alias("v"))

    return F.transform(parts, pair)


def query_value(query: Column, key: str) -> Column:
    """The first value of a key, null if there is none."""
    return F.get(F.filter(query_pairs(query), lambda p: p["k"] == key), F.lit(0))["v"]


def query_escape(s: Column) -> Column:
    """Everything but unreserved characters as %XX; a space as %20."""
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        s = F.replace(F.url_encode(s) if a == "+" else s, F.lit(a), F.lit(b))
    return s


def path_escape(s: Column) -> Column:
    """As query_escape, but sub-delimiters, : and @ stay."""
    s = query_escape(s)
    for c in "!$&'()*+,;=:@":
        s = F.replace(s, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return s


def query_unescape(s: Column) -> Column:
    """Null for a malformed escape; + is a space."""
    return F.try_url_decode(s)


def path_unescape(s: Column) -> Column:
    """Null for a malformed escape; + stays."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def replace_var(path: Column, key: str, value: Column) -> Column:
    """The first {key} replaced by the escaped value."""
    mark = "{" + key + "}"
    at = F.instr(path, mark)
    return F.when(at == 0, path).otherwise(F.concat(F.substring(path, F.lit(1), at - 1), path_escape(value), F.substring(path, at + len(mark), F.length(path))))


def add_query(url: Column, key: str, value: Column) -> Column:
    """key=value appended as it stands, before a fragment."""
    base, tail = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)?$", 1)
    sign = F.when(~F.contains(base, F.lit("?")), "?").when(base.endswith("?") | base.endswith("&"), "").otherwise("&")
    return F.concat(base, sign, F.lit(f"{key}="), value, tail)


def matches_domain(host: Column, pattern: str) -> Column:
    """A host, or with *. also its subdomains and the bare domain; ASCII case and a last dot don't matter."""
    h = ascii_lower(F.regexp_replace(host, r"\.$", ""))
    p = pattern.removesuffix(".").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    if not p.startswith("*."):
        return h == p
    return (h == p[2:]) | h.endswith(p[1:])


def related(a: Column, b: Column) -> Column:
    """Are two hosts equal, or is one a subdomain of the other?"""
    x, y = (ascii_lower(F.regexp_replace(h, r"\.$", "")) for h in (a, b))
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def cross_origin(a: Column, b: Column) -> Column:
    """Do two views differ in scheme, host name or effective port?"""
    same_host = equal_fold(F.regexp_replace(hostname(a["host"]), r"\.$", ""), F.regexp_replace(hostname(b["host"]), r"\.$", ""))
    return ~(equal_fold(a["scheme"], b["scheme"]) & same_host & (canonical_port(a["scheme"], a["host"]) == canonical_port(b["scheme"], b["host"])))


def ipv4(ip: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    ok = ip.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$")
    parts = F.split(ip, r"\.")
    return F.when(ok, F.aggregate(F.transform(parts, lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def ipv6(ip: Column) -> Column:
    """An IPv6 address as 32 lower-case hexadecimal digits, null for anything else; its last 32 bits may be written as IPv4."""
    tail = ipv4(F.regexp_extract(ip, r"^.*:([0-9.]+)$", 1))
    hexed = F.concat(F.regexp_extract(ip, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(F.lit(65535).cast("bigint")))))
    whole = F.when(F.contains(ip, F.lit(".")), F.coalesce(hexed, F.lit(""))).otherwise(F.lower(ip))
    group = "[0-9a-f]{1,4}"
    full = whole.rlike(f"^{group}(:{group}){{7}}$")
    short = whole.rlike(f"^({group}(:{group})*)?::({group}(:{group})*)?$")
    sides = F.transform(F.split(whole, "::"), lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
    left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    gap = 8 - F.size(left) - F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(full | (short & (gap >= 1)), digits)


def is_private(ip: Column) -> Column:
    """Loopback, link-local, unspecified, RFC 1918, carrier-grade NAT and unique local addresses; null, and what is no address, count as private."""
    six = ipv6(ip)
    mapped = F.when(six.startswith("0" * 20 + "ffff"), F.conv(F.substring(six, 25, 8), 16, 10).cast("bigint"))
    n = F.coalesce(ipv4(ip), mapped)
    blocks = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 24)]
    four = F.lit(False)
    for base, bits in blocks:
        a = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
        four = four | ((n >= a) & (n < a + (1 << (32 - bits))))
    own = six.isin("0" * 32, "0" * 31 + "1") | six.rlike("^(f[cd]|fe[89ab]|ff.2)")
    return F.when(n.isNotNull(), four).when(six.isNotNull(), own).otherwise(True)


def clean_host(host: Column) -> Column:
    """Without an IPv6 zone; international names in ASCII form. Only hosts with other than ASCII characters reach Python."""
    bare = F.when(host.rlike(r"^\[.*\]$"), F.concat(F.regexp_extract(host, r"^(\[[^%\]]*)", 1), F.lit("]"))).otherwise(F.regexp_extract(host, "^([^%]*)", 1))
    return F.when(bare.rlike(r"[^\x00-\x7F]"), to_ascii(bare)).otherwise(F.when(bare.rlike("[A-Z]") & ~F.contains(bare, F.lit(":")), ascii_lower(bare)).otherwise(bare))


@batched("string")
def to_ascii(hosts):
    def one(h: str | None) -> str | None:
        try:
            return h if h is None else h.lower().encode("idna").decode()
        except UnicodeError:
            return h

    return hosts.map(one)


@batched("string")
def resolve(base, ref):
    """A reference resolved against a base url (RFC 3986)."""
    from urllib.parse import urljoin

    return base.combine(ref, lambda a, b: None if a is None or b is None else urljoin(a, b))
