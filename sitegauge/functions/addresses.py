"""Internet addresses of both families as bits, and the ranges that hold them."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import once

#: Ranges that a crawl must not reach into: this host, private, shared, link-local, multicast and reserved ones.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/3", "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
)
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
MAPPED = "0" * 80 + "1" * 16


def base_two(text: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(text, base, 2), width, "0")


def v4_bits(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda x: base_two(x, 10, 8)), "")


def v6_bits(text: Column) -> Column:
    """128 bits of an address in groups; one ``::`` stands for as many zero groups as are missing, one at least."""
    tail = F.regexp_extract(text, r"[0-9.]+$", 0)
    low = v4_bits(tail)
    as_groups = F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.lower(F.conv(F.substring(low, 1, 16), 2, 16)), F.lit(":"), F.lower(F.conv(F.substring(low, 17, 16), 2, 16)))
    plain = F.when(F.contains(text, F.lit(".")), F.when(tail.rlike(V4), as_groups)).otherwise(text)

    def filled(own: Column) -> Column:
        sides = F.split(own, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        left, right = groups(0), groups(1)
        lacking = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(lacking, F.lit(0))), right)
        right_form = own.rlike("^(?:[0-9a-f]{1,4}(?::(?!:)|$|(?=::)))*(?:::(?:[0-9a-f]{1,4}(?::(?!:|$)|$))*)?$") & ~own.rlike("[^:]:$")
        counted = F.when(F.contains(own, F.lit("::")), lacking >= 1).otherwise(lacking == 0)
        return F.when(right_form & counted, F.array_join(F.transform(whole, lambda g: base_two(g, 16, 16)), ""))

    return once(plain, filled)


def address_bits(text: Column) -> Column:
    """An address as 128 binary digits, those of the fourth version behind the prefix under which the sixth knows them; null for other texts.

    Brackets around it are taken off, letters may be of either case, and octets have no leading zeros.
    """
    bare = F.lower(F.regexp_replace(F.trim(text), r"^\[|\]$", ""))
    return once(bare, lambda own: F.when(own.rlike(V4), F.concat(F.lit(MAPPED), v4_bits(own))).when(F.contains(own, F.lit(":")), v6_bits(own)))


def range_bits(cidr: str) -> str:
    """The digits that all addresses of a range begin with."""
    net = ip_network(cidr)
    prefix, whole = ("", 128) if net.version == 6 else (MAPPED, 32)
    return prefix + f"{int(net.network_address):0{whole}b}"[: net.prefixlen]


def in_any(bits: Column, ranges: tuple[str, ...] = PRIVATE) -> Column:
    """Whether one of a few fixed ranges holds the address."""
    found = F.lit(False)
    for r in ranges:
        found = found | F.startswith(bits, F.lit(range_bits(r)))
    return found


def is_public(text: Column, ranges: tuple[str, ...] = PRIVATE) -> Column:
    """Whether the text is an address that none of ``ranges`` holds; texts that are no address are not public."""
    return once(address_bits(text), lambda bits: F.coalesce(~in_any(bits, ranges), F.lit(False)))


def longest_ranges(addresses: DataFrame, ranges: DataFrame, address: str = "address", cidr: str = "cidr") -> DataFrame:
    """The addresses with ``cidr``, the smallest range of the table that holds each; null without one.

    ``ranges`` has the text of each range (both families). It may be large: an interval join on whole prefixes. Ranges have few different lengths; an
    address is cut at those lengths only, and its beginnings meet the ranges' as equal keys, which spread over tasks. Of equal ranges the least text counts.
    """
    base, length = F.split(cidr, "/")[0], F.split(cidr, "/")[1].cast("int")
    whole = F.when(F.contains(base, F.lit(":")), length).otherwise(length + 96)
    named = ranges.select(F.col(cidr).alias("cidr"), F.substring(address_bits(base), F.lit(1), whole).alias("begin"), whole.alias("n")).where("begin is not null")
    named = named.groupBy("begin", "n").agg(F.min("cidr").alias("cidr"))
    lengths = sorted(r["n"] for r in named.select("n").distinct().collect())  # 129 at most
    known = addresses.select(F.col(address).alias("__a")).distinct().select("__a", address_bits(F.col("__a")).alias("bits")).where("bits is not null")
    cut = known.select("__a", "bits", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")).select("__a", "n", F.substring("bits", F.lit(1), F.col("n")).alias("begin"))
    best = cut.join(named, ["begin", "n"]).groupBy("__a").agg(F.max_by("cidr", "n").alias("cidr"))
    return addresses.join(best, F.col(address) == F.col("__a"), "left").drop("__a")


#: Why an address of a page is refused before it is fetched.
REFUSALS = ("no address", "other scheme", "private host", "private address")


def refusal(url: Column, ranges: tuple[str, ...] = PRIVATE) -> Column:
    """Why a url (in one spelling, see ``functions.urls``) must not be fetched; null if it may be, or its host has yet to be looked up."""
    scheme, host = F.regexp_extract(url, "^([^:]*):", 1), F.regexp_extract(url, r"^[^:]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    bits = address_bits(host)
    return (
        F.when(url.isNull() | (host == ""), REFUSALS[0]).when(~scheme.isin("http", "https"), REFUSALS[1]).when(host.rlike(r"(?:^|\.)localhost$|\.internal$"), REFUSALS[2])
        .when(bits.isNotNull() & in_any(bits, ranges), REFUSALS[3])
    )
