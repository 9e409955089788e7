"""Column functions on addresses: origins, identities, private hosts, request verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def authority(u: Column) -> Column:
    """host[:port] without credentials, '' where there is none."""
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def hostname(u: Column) -> Column:
    """Lower-case host without port or brackets."""
    a = authority(u)
    return F.lower(F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(a, r":\d*$", "")))


def origin(u: Column) -> Column:
    """scheme://host[:port]; an address without authority has its scheme and a colon; '' where
    there is no scheme."""
    s = F.regexp_extract(u, _SCHEME, 1)
    return F.when(authority(u) != "", F.concat(s, F.lit("://"), authority(u))).when(s != "", F.concat(s, F.lit(":"))).otherwise("")


def web_origin(u: Column) -> Column:
    return F.when(scheme(u).isin("http", "https"), origin(u)).otherwise("")


def without_fragment(u: Column) -> Column:
    return F.substring_index(u, "#", 1)


def document_id(u: Column, root: Column) -> Column:
    return F.concat_ws(" ", without_fragment(u), root.cast("string"))


def with_scheme(u: Column) -> Column:
    """An address typed without a scheme gets https; host:port is no scheme."""
    typed = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~u.rlike(r"^[^/?#:]+:\d+(?:[/?#]|$)")
    return F.when(typed, u).otherwise(F.concat(F.lit("https://"), u))


def ipv4_value(host: Column) -> Column:
    """The 32-bit value of an IPv4 host as browsers read it: one to four parts, each decimal,
    octal (leading 0) or hexadecimal (leading 0x); null for anything else."""
    parts = F.split(host, r"\.")
    valid = host.rlike(r"(?i)^(?:0x[0-9a-f]+|0[0-7]*|[1-9]\d*)(?:\.(?:0x[0-9a-f]+|0[0-7]*|[1-9]\d*)){0,3}$") & ~host.rlike(r"(?i)(?:^|\.)(?:0x0*[0-9a-f]{9,}|[1-9]\d{10,}|0+[1-9]\d{11,})(?:\.|$)")
    numbers = F.transform(parts, lambda p: F.when(p.rlike("(?i)^0x"), F.conv(F.substring(p, 3, 64), 16, 10)).when(p.rlike(r"^0\d"), F.conv(p, 8, 10)).otherwise(p).try_cast("long"))
    n = F.size(numbers)
    head = F.aggregate(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.struct(F.lit(0).cast("long").alias("v"), F.lit(3).alias("k"), F.lit(True).alias("ok")), lambda a, x: F.struct((a["v"] + x * F.pow(F.lit(256.0), a["k"]).cast("long")).alias("v"), (a["k"] - 1).alias("k"), (a["ok"] & (x <= 255)).alias("ok")))
    last = F.element_at(numbers, -1)
    fits = last < F.pow(F.lit(256.0), 5 - n).cast("long")
    return F.when(valid & head["ok"] & fits, head["v"] + last)


def private_ipv4(v: Column) -> Column:
    """Loopback, private, link-local, link-local multicast, unspecified, this-network and shared ranges."""

    def within(first: int, bits: int) -> Column:
        return F.shiftright(v, 32 - bits) == (first >> (32 - bits))

    def at(a: int, b: int = 0, c: int = 0, d: int = 0) -> int:
        return a << 24 | b << 16 | c << 8 | d

    ranges = ((at(127), 8), (at(10), 8), (at(172, 16), 12), (at(192, 168), 16), (at(169, 254), 16), (at(224), 24), (at(0), 8), (at(100, 64), 10))
    out = F.lit(False)
    for first, bits in ranges:
        out = out | within(first, bits)
    return out


def private_name(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    return (h == "localhost") | h.endswith(".localhost")


def private_host(host: Column) -> Column:
    """Local names and private IPv4 hosts; IPv6 is judged by ``operators.policy.ipv6_hosts``."""
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    return private_name(h) | F.coalesce(private_ipv4(ipv4_value(h)), F.lit(False))


def request_reason(u: Column, kind: Column, private: Column, allowed: Column | None = None) -> Column:
    """Why a request is refused; null where it may go.

    ``private`` says whether the host is private; ``allowed`` holds the lower-case origins a
    document may come from, null or empty for any.
    """
    s = scheme(u)
    own = F.lower(origin(u))
    outside = F.lit(False) if allowed is None else (F.size(F.coalesce(allowed, F.array().cast("array<string>"))) > 0) & ~F.array_contains(allowed, own)
    web = s.isin("http", "https", "ws", "wss")
    return (
        F.when(u.isNull() | u.rlike(r"[\x00-\x20\x7f]"), "not a URL")
        .when(s == "", "no scheme")
        .when(s.isin("data", "blob") & (kind == "Document"), "document from opaque scheme")
        .when(s.isin("data", "blob", "about"), F.lit(None))
        .when(~web, "scheme not allowed")
        .when(private, "private address")
        .when((kind == "Document") & outside, "outside the allowed origins")
    )
