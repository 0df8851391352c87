"""Addresses of both families as two 64-bit halves, and the narrowest network that holds one.

An IPv4 address stands at its mapped place (::ffff:a.b.c.d), so both families share one space of 128 bits and a network is an address with a number
of leading bits.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.functions.geometry import let
from cutledger.operators.billing import ip_to_long
from cutledger.session import kept

#: Where IPv4 addresses stand, and the leading bits before them.
MAPPED, MAPPED_BITS = 0xFFFF00000000, 96
#: Loopback and private blocks, which have no country.
PRIVATE = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "::1/128", "fc00::/7")


def _halves(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))


def _signed(hex16: Column) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit number."""
    return F.conv(hex16, 16, -10).cast("bigint")


def _six(text: Column) -> Column:
    """IPv6 text (lower case, no zone) as halves; NULL if malformed. An IPv4 tail counts as two groups."""
    tail = F.regexp_extract(text, r"^(.*:)(\d+(?:\.\d+){3})$", 2)
    four = ip_to_long(F.when(tail != "", tail))
    groups16 = F.concat_ws(":", F.lower(F.hex(F.floor(four / 65_536))), F.lower(F.hex(four % 65_536)))
    plain = F.when(tail == "", text).when(four.isNotNull(), F.concat(F.regexp_extract(text, r"^(.*:)(\d+(?:\.\d+){3})$", 1), groups16))
    listed = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def read(p: Column) -> Column:
        parts = F.split(p["t"], "::")
        left, right = listed(F.get(parts, 0)), F.when(F.size(parts) == 2, listed(F.get(parts, 1))).otherwise(F.array().cast("array<string>"))
        many = F.size(left) + F.size(right)
        gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - many, F.lit(0)))
        groups = F.concat(left, gap, right)
        good = ((F.size(parts) == 1) & (many == 8)) | ((F.size(parts) == 2) & (many <= 7))
        digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        fine = good & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fine, _halves(_signed(F.substring(digits, 1, 16)), _signed(F.substring(digits, 17, 16))))

    return let(F.struct(plain.alias("t")), read)


def address_bits(ip: Column) -> Column:
    """Address text of either family as struct(hi, lo); NULL if it is none."""
    text = F.lower(F.regexp_replace(F.trim(ip), "%.*$", ""))
    four = ip_to_long(text)
    return F.when(text.contains(":"), _six(text)).when(four.isNotNull(), _halves(F.lit(0), four + MAPPED))


def _leading(half: Column, bits: Column) -> Column:
    """A half with all but its first bits cleared."""
    drop = (F.lit(64) - bits).cast("int")
    kept = F.call_function("shiftleft", F.call_function("shiftright", half, drop), drop)
    return F.when(bits >= 64, half).when(bits <= 0, F.lit(0).cast("bigint")).otherwise(kept)


def network_of(bits: Column, prefix: Column) -> Column:
    """The network of an address: its first ``prefix`` bits."""
    return _halves(_leading(bits["hi"], prefix), _leading(bits["lo"], prefix - 64))


def parse_networks(networks: DataFrame) -> DataFrame:
    """(network, prefix, country_code) from text such as 203.0.113.0/24 or 2001:db8::/32; a bare address is one host, malformed text is dropped.

    Bits behind the prefix are cleared. Of rows for the same network the least country stays.
    """
    parts = F.split("network", "/")
    bits, given = address_bits(F.get(parts, 0)), F.get(parts, 1)
    six = F.get(parts, 0).contains(":")
    whole = F.when(six, 128).otherwise(32)
    length = F.when(given.isNull(), whole).otherwise(given.try_cast("int"))
    read = networks.select(bits.alias("bits"), F.when(length.between(0, whole), F.when(six, length).otherwise(length + MAPPED_BITS)).alias("prefix"), "country_code")
    good = read.where("bits is not null and prefix is not null").withColumn("network", network_of(F.col("bits"), F.col("prefix")))
    return good.groupBy("network", "prefix").agg(F.min("country_code").alias("country_code"))


def is_local(bits: Column) -> Column:
    """Loopback and private addresses of both families."""
    hit = F.lit(False)
    for text in PRIVATE:
        block = ipaddress.ip_network(text)
        four = block.version == 4
        prefix = F.lit(block.prefixlen + (MAPPED_BITS if four else 0))
        halves = divmod(int(block.network_address) + (MAPPED if four else 0), 1 << 64)
        hi, lo = (F.lit(h - (1 << 64) if h >> 63 else h) for h in halves)
        hit = hit | ((_leading(bits["hi"], prefix) == hi) & (_leading(bits["lo"], prefix - 64) == lo))
    return hit


def country_for_address(df: DataFrame, networks: DataFrame) -> DataFrame:
    """Add ip_country: that of the narrowest network that holds the address in ``ip``; NULL for local, malformed and unknown ones.

    Networks (network, country_code) may nest. Distinct addresses look for their own network at each prefix length that occurs (at most 129,
    the only thing collected), an equal join per length; the longest match wins.
    """
    known = parse_networks(networks)
    lengths = sorted(r[0] for r in known.select("prefix").distinct().collect())
    if not lengths:
        return df.withColumn("ip_country", F.lit(None).cast("string"))
    # read twice below: reading an address from its text costs more than all that follows
    placed = kept(df.withColumn("_bits", address_bits(F.col("ip"))), "addresses")
    wanted = placed.select(F.col("_bits").alias("bits")).where("bits is not null").distinct().where(~is_local(F.col("bits")))
    probes = wanted.select("bits", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("prefix"))
    probes = probes.withColumn("network", network_of(F.col("bits"), F.col("prefix")))
    found = probes.join(known, ["network", "prefix"]).groupBy("bits").agg(F.max_by("country_code", "prefix").alias("ip_country"))
    return placed.join(found.withColumnRenamed("bits", "_bits"), "_bits", "left").drop("_bits")
