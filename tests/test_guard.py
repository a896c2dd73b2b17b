"""Addresses against Python's own parser, and limits as a stream."""

import random
from ipaddress import IPv4Address, IPv6Address, ip_address, ip_network

from pyspark.sql import functions as F

from sitegauge.functions import addresses
from sitegauge.operators.limits import rate_limited
from sitegauge.streaming import limits


def bits(text):
    try:
        a = ip_address(text)
    except ValueError:
        return None
    return f"{int(a):0128b}" if isinstance(a, IPv6Address) else addresses.MAPPED + f"{int(a):032b}"


ODD = [
    "", " ", ":", "::", ":::", "1::", "::1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", "1:", ":1", "1:2:3:4:5:6:7:",
    "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.256", "1.2.3.4::", "::1.2.3.4:5", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.4 ", "a.b.c.d", "1..2.3",
    "-1.2.3.4", "fe80::1%eth0", "ABCD:EF01::", "::FFFF:10.0.0.1", "0:0:0:0:0:0:0:0", "1.2.3.4/8",
]


def test_bits_of_addresses(spark):
    rng = random.Random(1)
    made = [str(IPv4Address(rng.getrandbits(32))) for _ in range(100)]
    for _ in range(300):
        groups = [f"{rng.getrandbits(16) if rng.random() < 0.5 else 0:x}" for _ in range(8)]
        a, b = sorted(rng.sample(range(9), 2))
        made += [":".join(groups), ":".join(groups[:a]) + "::" + ":".join(groups[b:]), str(IPv6Address(int(rng.getrandbits(128)) & rng.getrandbits(128)))]
    texts = ODD + made
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.address_bits(F.col("t")).alias("b"), addresses.is_public(F.col("t")).alias("p"))
    nets = [ip_network(r) for r in addresses.PRIVATE]
    for r in df.collect():
        want = None if "%" in r.t else bits(r.t.strip())
        assert r.b == want, r.t
        a = None if want is None else ip_address(r.t.strip())
        a = a.ipv4_mapped if isinstance(a, IPv6Address) and a.ipv4_mapped else a
        assert r.p == (a is not None and not any(a.version == n.version and a in n for n in nets)), r.t


def test_edges_of_private_ranges(spark):
    edges = [(str(x), x.version == 4 or True) for r in addresses.PRIVATE for n in [ip_network(r)] for x in (n.network_address, n.broadcast_address)]
    df = spark.createDataFrame([(t,) for t, _ in edges], "t string")
    assert df.where(addresses.is_public(F.col("t"))).count() == 0
    outside = ["1.0.0.0", "9.255.255.255", "11.0.0.0", "100.63.255.255", "100.128.0.0", "172.15.255.255", "172.32.0.0", "223.255.255.255", "::2", "fbff::", "fe00::", "fec0::", "feff::", "[2606:4700::1]", "::ffff:8.8.8.8"]
    assert spark.createDataFrame([(t,) for t in outside], "t string").where(~addresses.is_public(F.col("t"))).count() == 0


def test_the_smallest_range_wins(spark):
    rng = random.Random(2)
    ranges = [str(ip_network((rng.getrandbits(32), n), strict=False)) for n in rng.choices(range(4, 20), k=60)] + [str(ip_network((rng.getrandbits(128), n), strict=False)) for n in rng.choices(range(1, 12), k=40)] + ["0.0.0.0/0"]
    rows = [str(IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [str(IPv6Address(rng.getrandbits(128))) for _ in range(200)] + ["nothing", None, "1.2.3.4", "1.2.3.4"]
    got = addresses.longest_ranges(spark.createDataFrame([(t, 1) for t in rows], "address string, bits int"), spark.createDataFrame([(r,) for r in [*ranges, "bad/3"]], "cidr string")).collect()
    assert len(got) == len(rows)
    nets = [ip_network(r) for r in ranges]
    for r in got:
        a = ip_address(r.address) if r.address not in (None, "nothing") else None
        holding = [n for n in nets if a is not None and n.version == a.version and a in n]
        best = max((n.prefixlen for n in holding), default=None)
        assert r.cidr == min((str(n) for n in holding if n.prefixlen == best), default=None), r
    assert addresses.longest_ranges(spark.createDataFrame([("1.2.3.4",)], "address string"), spark.createDataFrame([], "cidr string")).first().cidr is None


def test_refusals(spark):
    urls = {"http://8.8.8.8/": None, "https://a.example/": None, "ftp://a.example/": "other scheme", "http://127.0.0.1/": "private address", "http://[::1]:80/": "private address", "http://u@10.0.0.1/": "private address",
            "http://localhost/": "private host", "http://a.localhost/": "private host", "http://db.internal/x": "private host", "http://notlocalhost/": None, None: "no address", "mailto:a@b": "no address"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", addresses.refusal(F.col("u")).alias("r"))
    assert {r.u: r.r for r in df.collect()} == urls


def test_a_limit_goes_on_after_a_restart_and_forgets_keys(spark, tmp_path):
    start, schema = 1_700_000_000, "k string, s long"
    parts = [[("a", 0), ("a", 20), ("a", 10), ("b", 15), ("a", 10)], [("a", 3601), ("a", 3605), ("b", 3700)], [("c", 20_000)], [("b", 20_001), ("b", 20_001), ("b", 20_002), ("a", 20_003), (None, 20_004)], [("d", 90_000)]]
    folder = str(tmp_path / "run")

    def take():
        stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        limits.run_limited(spark, stream, "k", "ts", folder, 2).awaitTermination()
        return {r["key"]["k"] for r in limits.live_keys(spark, folder).collect()}

    live = []
    for part in parts:
        df = spark.createDataFrame([(k, start + s) for k, s in part], schema).select("k", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part is not parts[1]:  # the second and third files are two micro-batches of one run
            live.append(take())
    assert live == [{"a", "b"}, {"c"}, {"a", "b", "c", None}, {"d"}]
    every = spark.createDataFrame([(k, start + s) for part in parts for k, s in part], schema)
    key = lambda r: (r[0] or "", *r[1:])
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/answers").collect()), key=key)
    assert got == sorted(map(tuple, rate_limited(every, "k", "s", 2).collect()), key=key)
