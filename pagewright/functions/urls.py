"""URL columns: splitting by the generic syntax, normal form, origin, host, resolution and private addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI syntax, part by part.
_GENERIC = r"\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# Address ranges that are not public, as the address library counts them: fixed values.
_PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
_PUBLIC_V4 = ("192.0.0.9", "192.0.0.10")
_V4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\z"


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(url, _GENERIC, number)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def host(url: Column) -> Column:
    """Lower-case host without user, port and brackets; empty where there is none."""
    place = F.regexp_replace(netloc(url), r"\A.*@", "")
    bracketed = F.regexp_extract(place, r"\A\[([^\]]*)\]", 1)
    return F.lower(F.when(place.startswith("["), bracketed).otherwise(F.regexp_extract(place, r"\A([^:]*)", 1)))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def normalize(url: Column) -> Column:
    """For comparison only: scheme and place in lower case, no slash at the end, no parameters, no fragment."""
    query = part(url, 4)
    # Parameters hang on the last segment.
    plain = F.regexp_replace(path(url), r";[^/]*\z", "")
    trimmed = F.regexp_replace(plain, r"/+\z", "")
    place = F.when(netloc(url) != "", F.concat(F.lit("//"), F.lower(netloc(url)))).otherwise("")
    name = F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise("")
    return F.concat(name, place, F.when(trimmed == "", "/").otherwise(trimmed), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _number(address: str) -> int:
    return int(ipaddress.IPv4Address(address))


def is_v4(text: Column) -> Column:
    return text.rlike(_V4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def private_v4(address: Column) -> Column:
    """Whether a dotted address lies in a range that is not public; compared as numbers."""
    ranges = F.array(*(F.struct(F.lit(_number(base)).cast("long").alias("low"), F.lit(_number(base) + (1 << (32 - bits)) - 1).cast("long").alias("high")) for base, bits in _PRIVATE_V4))
    number = lambda d: sum((d[k].cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))
    inside = let(let(F.split(F.when(is_v4(address), address), r"\."), number), lambda n: F.exists(ranges, lambda r: n.between(r["low"], r["high"])))
    return F.coalesce(inside & ~address.isin(*_PUBLIC_V4), F.lit(False))


def not_public(address: str) -> bool:
    """Whether an address, as a literal, is one that no page may be loaded from; what is no address is not."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def _groups(address: Column) -> Column:
    """The eight groups of a longer address as numbers, null where the text is none; a dotted tail counts as two groups."""
    plain = F.regexp_extract(address, r"\A([^%]*)(?:%[^%]+)?\z", 1)
    dotted = F.regexp_extract(plain, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z", 1)
    pair = lambda d, k: F.lower(F.hex(d[k].cast("int") * 256 + d[k + 1].cast("int")))
    tail = let(F.split(F.when(is_v4(dotted), dotted), r"\."), lambda d: F.concat(pair(d, 0), F.lit(":"), pair(d, 2)))
    whole = F.when(dotted == "", plain).otherwise(F.concat(F.regexp_replace(plain, r"[0-9.]+\z", ""), tail))
    side = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def filled(text: Column) -> Column:
        gap = F.instr(text, "::")
        left = side(F.when(gap > 0, F.substring(text, F.lit(1), gap - 1)).otherwise(text))
        right = side(F.when(gap > 0, F.substring(text, gap + 2, F.length(text))).otherwise(""))
        held = F.size(left) + F.size(right)
        fits = F.when(gap > 0, held < 8).otherwise(held == 8)
        parts = F.concat(left, F.array_repeat(F.lit("0"), F.when(fits & (gap > 0), 8 - held).otherwise(0)), right)
        good = fits & F.forall(parts, lambda g: g.rlike(r"\A[0-9A-Fa-f]{1,4}\z"))
        return F.when(good, F.transform(parts, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(whole, filled)


def private_v6(address: Column) -> Column:
    """Whether an address of the longer kind is not public; one that wraps a dotted address counts as that.

    Public are 2000::/3 without what is set aside there, and fec0::/10.
    """

    def judge(g: Column) -> Column:
        first, second, third = g[0], g[1], g[2]
        mapped = (F.aggregate(F.slice(g, 1, 5), F.lit(0), lambda a, x: a + x) == 0) & (g[5] == 0xFFFF)
        inner = F.format_string("%d.%d.%d.%d", F.shiftright(g[6], 8), g[6].bitwiseAND(255), F.shiftright(g[7], 8), g[7].bitwiseAND(255))
        zeros = F.aggregate(F.slice(g, 3, 5), F.lit(0), lambda a, x: a + x) == 0
        # Of 2001::/23 some blocks are public all the same: fixed values.
        open_ = ((second == 1) & zeros & g[7].isin(1, 2, 3)) | (second == 3) | ((second == 4) & (third == 0x112)) | second.between(0x20, 0x3F)
        aside = ((first == 0x2001) & (((second < 0x200) & ~open_) | (second == 0xDB8))) | (first == 0x2002)
        public = (first.between(0x2000, 0x3FFF) & ~aside) | first.between(0xFEC0, 0xFEFF)
        return F.when(mapped, private_v4(inner)).otherwise(~public)

    return F.coalesce(let(address, lambda a: let(_groups(a), judge)), F.lit(False))


def private_address(address: Column) -> Column:
    return F.when(address.contains(":"), private_v6(address)).otherwise(private_v4(address))


def is_address(text: Column) -> Column:
    return is_v4(text) | text.contains(":")


def percent_encoded(text: Column) -> Column:
    """Characters outside ASCII as percent-encoded UTF-8; the rest as it is."""
    one = lambda c: F.when(c.rlike(r"\A[\x00-\x7f]\z"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _without_dots(path: Column) -> Column:
    """Dot segments taken out, as a browser does; never above the first slash."""
    segments = F.split(path, "/")
    up, here = F.lit(".."), F.lit(".")
    step = lambda held, s: F.when(s == up, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).when(s == here, held).otherwise(F.concat(held, F.array(s)))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.slice(segments, 1, 1), step)
    ends = F.element_at(segments, -1).isin("..", ".")
    return F.array_join(F.when(ends, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve(base: Column, reference: Column) -> Column:
    """A reference as it would be followed from `base`, by expressions alone; what cannot be resolved stays as it is, null stays
    null. Characters outside ASCII are percent-encoded."""
    parts = lambda u: F.struct(part(u, 1).alias("scheme"), part(u, 2).alias("place"), part(u, 3).alias("path"), u.alias("whole"))

    def joined(x: Column) -> Column:
        b, r = x["b"], x["r"]
        mark = F.regexp_extract(r["whole"], r"(?s)(#.*)\z", 1)
        asked = F.regexp_extract(r["whole"], r"\A[^?#]*(\?[^#]*)", 1)
        own = F.regexp_extract(b["whole"], r"\A[^?#]*(\?[^#]*)", 1)
        root = F.concat(b["scheme"], F.lit("://"), b["place"])
        folder = F.when(b["path"] == "", "/").otherwise(F.regexp_replace(b["path"], r"[^/]*\z", ""))
        same = (r["scheme"] == "") | ((F.lower(r["scheme"]) == F.lower(b["scheme"])) & ~F.substring(r["whole"], F.length(r["scheme"]) + 2, F.lit(2)).eqNullSafe("//"))
        return (
            F.when(~same | (b["scheme"] == "") | (b["place"] == ""), r["whole"]).when(r["place"] != "", F.concat(b["scheme"], F.lit("://"), r["place"], r["path"], asked, mark))
            .when((r["path"] == "") & (asked == ""), F.concat(root, b["path"], own, mark)).when(r["path"] == "", F.concat(root, b["path"], asked, mark))
            .when(r["path"].startswith("/"), F.concat(root, _without_dots(r["path"]), asked, mark))
            .otherwise(F.concat(root, _without_dots(F.concat(folder, r["path"])), asked, mark))
        )

    def resolved(x: Column) -> Column:
        told = F.struct(parts(x["base"]).alias("b"), parts(F.regexp_replace(x["reference"], r"\A[ \t\n\r\f]+|[ \t\n\r\f]+\z", "")).alias("r"))
        return percent_encoded(let(told, joined))

    # All inside of one function, so that a plan that resolves and vets stays small enough to be compiled.
    return let(F.when(reference.isNotNull(), F.struct(base.alias("base"), reference.alias("reference"))), resolved)
