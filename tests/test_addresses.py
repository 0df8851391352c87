"""Addresses of both families against the standard library, and the narrowest network."""

import ipaddress
import random

from pyspark.sql import functions as F

from cutledger.operators import addresses as ad

MASK = (1 << 64) - 1


def number(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)


def test_addresses_are_read_as_the_standard_library_does(spark):
    rnd = random.Random(1)
    texts = ["::", "::1", "1::", "2001:DB8::1", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "255.255.255.255", "0.0.0.0", "fe80::1%eth0"]
    bad = ["", " ", "1", "1.2.3", "256.1.1.1", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1:2:3:4:5:6:7", "::1.2.3", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", None]
    texts += [str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.choice([-1, ~(0xFFFFFFFF << 40), MASK << 64]))) for _ in range(200)]
    texts += [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts + bad], "ip string").withColumn("b", ad.address_bits(F.col("ip")))
    for r in df.collect():
        got = None if r.b is None else ((r.b.hi & MASK) << 64) + (r.b.lo & MASK)
        assert got == number((r.ip or "").split("%")[0]), r.ip


def test_the_narrowest_network_wins(spark):
    rnd = random.Random(2)
    nets = [(f"{ipaddress.ip_network((rnd.getrandbits(32) & 0x0F0F0000 | 0x20000000, p), strict=False)}", f"A{p}") for p in (3, 8, 9, 15, 16, 20, 24, 31, 32) for _ in range(6)]
    nets += [(f"{ipaddress.ip_network(((0x20010DB8 << 96) | (rnd.getrandbits(3) << 77) | rnd.getrandbits(4), p), strict=False)}", f"B{p}") for p in (12, 32, 48, 52, 63, 64, 65, 126, 128) for _ in range(6)]
    nets += [("10.0.0.0/8", "PRIVATE"), ("::1", "LOOP"), ("8.8.8.8", "HOST"), ("8.8.8.8/32", "GUEST"), ("nonsense/3", "X"), ("1.2.3.4/40", "X"), ("0.0.0.0/0", "WORLD")]
    ips = [str(ipaddress.IPv4Address(rnd.getrandbits(32) & 0x0F0F0303 | 0x20000000)) for _ in range(150)] + ["10.1.2.3", "::1", "fd00::1", "8.8.8.8", "bad", None, "192.168.0.1", "::ffff:8.8.8.8"]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) | (rnd.getrandbits(3) << 77) | rnd.getrandbits(4))) for _ in range(150)]
    ips += ["10.1.2.3"]
    known = {}
    for text, country in nets:
        try:
            n = ipaddress.ip_network(text)
        except ValueError:
            continue
        known[n] = min(country, known.get(n, country))
    want = {}
    for ip in set(ips):
        try:
            a = ipaddress.ip_address(ip)
            a = getattr(a, "ipv4_mapped", None) or a
        except ValueError:
            want[ip] = None
            continue
        holds = [n for n in known if n.version == a.version and a in n]
        local = a.is_loopback or any(a in ipaddress.ip_network(b) for b in ad.PRIVATE if ipaddress.ip_network(b).version == a.version)
        want[ip] = known[max(holds, key=lambda n: n.prefixlen)] if holds and not local else None
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, ip string")
    got = ad.country_for_address(df, spark.createDataFrame(nets, "network string, country_code string")).collect()
    assert len(got) == len(ips) and {r.ip: r.ip_country for r in got} == want


def test_no_networks(spark):
    df = spark.createDataFrame([("1.1.1.1",)], "ip string")
    assert ad.country_for_address(df, spark.createDataFrame([], "network string, country_code string")).first().ip_country is None
