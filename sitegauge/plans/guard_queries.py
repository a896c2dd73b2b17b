"""Queries of addresses and limits, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitegauge.functions import addresses
from sitegauge.functions.urls import origins, resolved
from sitegauge.plans.audit_oracles import ORACLES as AUDIT
from sitegauge.sources.staging import shared_folder
from sitegauge.sources.tables import read_table
from sitegauge.streaming import limits

#: Ranges that addresses are looked up in, one within another here and there.
RANGES = ("10.0.0.0/8", "10.64.0.0/10", "100.64.0.0/10", "172.16.0.0/12", "192.0.0.0/3", "192.168.0.0/16", "224.0.0.0/3", "0.0.0.0/0", "2001:db8::/32", "2001:db8:40::/43", "fc00::/7", "fe80::/10", "::/96")


def numbers():
    """Four octets and eight groups of each customer, by fixed multiples of the key."""
    k = F.col("c_custkey")
    octets = [F.get(F.array(*map(F.lit, (10, 100, 127, 169, 172, 192, 224, 8, 193, 0))), (k % 10).cast("int")), k * 7 % 256, k * 31 % 256, k * 3 % 256]
    first = F.get(F.array(*map(F.lit, (0x2001, 0xFC00, 0xFDFF, 0xFE80, 0xFEC0, 0xFF02, 0))), (k % 7).cast("int"))
    return octets, [first, F.when(k % 2 == 0, 0x0DB8).otherwise(0), k * 11 % 128, F.lit(0), F.lit(0), F.lit(0), F.lit(0), k % 3]


def texts():
    """An address of the fourth version; one of the sixth with all its groups, with zeros left out, and with dots."""
    octets, groups = numbers()
    dotted = F.concat_ws(".", *[o.cast("string") for o in octets])
    hexed = [F.lower(F.hex(g)) for g in groups]
    return {
        "v4": dotted, "v6": F.concat_ws(":", *[F.lpad(h, 4, "0") for h in hexed]), "short": F.concat(F.concat_ws(":", *hexed[:3]), F.lit("::"), hexed[7]),
        "mapped": F.concat(F.lit("[::FFFF:"), dotted, F.lit("]")), "wrong": F.concat(dotted, F.lit("."), dotted),
    }


def public_addresses(spark, sf_dir):
    """Customers' addresses in several spellings: which may be fetched from."""
    return read_table(spark, sf_dir, "customer").select("c_custkey", *[addresses.is_public(t).alias(n) for n, t in texts().items()])


def address_ranges(spark, sf_dir):
    """The smallest range of a table that holds each address."""
    some = F.explode(F.array(*[texts()[n] for n in ("v4", "v6", "short", "mapped", "wrong")])).alias("address")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", some)
    return addresses.longest_ranges(rows, spark.createDataFrame([(r,) for r in RANGES], "cidr string"))


def page_origins(spark, sf_dir):
    """Pages' addresses in odd spellings, which all come to one; their origins; and why some of them are refused."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+", 0).alias("scheme"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*(.*)$", 1).alias("rest"))
    port = F.when(F.col("scheme") == "https", ":443").otherwise(":80")
    odd = F.concat(F.lit(" \t"), F.upper("scheme"), F.lit(":\\\\"), F.upper("host"), port, F.lit("\\a\\.\\b/%2E%2e\\../"), F.substring("rest", 2, 10_000), F.lit("\n"))
    beside = resolved(F.concat(F.lit("../../.."), "rest"), F.concat("scheme", F.lit("://"), "host", F.lit("/x/y/z?q#f")))
    inside = F.when(F.col("page_id") % 3 == 0, F.concat("scheme", F.lit("://10."), (F.col("page_id") % 256).cast("string"), F.lit(".1/"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://"), "host", F.lit(".LOCALHOST/"))).otherwise(F.col("url"))
    return pages.select("page_id", resolved(odd).alias("absolute"), beside.alias("beside"), origins(odd).alias("origin"), addresses.refusal(resolved(inside)).alias("refusal"))


def rate_limits_stream(spark, sf_dir):
    """``rate_limits`` of the events as a stream, in three micro-batches with a restart before the last."""
    events, folder = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), shared_folder(spark, f"limits-{uuid.uuid4().hex}")
    low, high = events.selectExpr("min(unix_seconds(ts))", "max(unix_seconds(ts))").first()
    edges = [low + (high - low) * k // 3 for k in (1, 2)] if low is not None else []
    second = F.unix_seconds("ts")
    parts = [events.where(second < edges[0]), events.where((second >= edges[0]) & (second < edges[1])), events.where(second >= edges[1])] if edges else [events]
    stream = lambda: spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
    for part in parts:  # each run goes on where the one before it ended
        part.write.mode("append").parquet(f"{folder}/events")
        limits.run_limited(spark, stream(), "user_id", "ts", folder, 2, 86_400).awaitTermination()
    return spark.read.schema("user_id bigint, at bigint, accepted boolean, wait bigint").parquet(f"{folder}/answers")


QUERIES = {f.__name__: f for f in (public_addresses, address_ranges, page_origins, rate_limits_stream)}

NUMBERS = """n AS (SELECT c_custkey, [10, 100, 127, 169, 172, 192, 224, 8, 193, 0][c_custkey % 10 + 1] AS a, c_custkey * 7 % 256 AS b, c_custkey * 31 % 256 AS c, c_custkey * 3 % 256 AS d,
    [8193, 64512, 65023, 65152, 65216, 65282, 0][c_custkey % 7 + 1] AS g, CASE c_custkey % 2 WHEN 0 THEN 3512 ELSE 0 END AS h, c_custkey * 11 % 128 AS i, c_custkey % 3 AS z FROM customer)"""
TEXTS = """t AS (SELECT *, a || '.' || b || '.' || c || '.' || d AS v4, lower(printf('%04x:%04x:%04x:0000:0000:0000:0000:%04x', g, h, i, z)) AS v6, lower(printf('%x:%x:%x::%x', g, h, i, z)) AS short FROM n)"""
ORACLES = {
    "public_addresses": f"""WITH {NUMBERS},
      p AS (SELECT c_custkey, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) AS v4,
        NOT (g BETWEEN 64512 AND 65023 OR g BETWEEN 65152 AND 65215 OR g >= 65280 OR (g = 0 AND h = 0 AND i = 0 AND z < 2)) AS v6 FROM n)
      SELECT c_custkey, v4, v6, v6 AS short, v4 AS mapped, FALSE AS wrong FROM p""",
    "address_ranges": f"""WITH {NUMBERS}, {TEXTS},
      four AS (SELECT *, CASE WHEN a = 10 AND b BETWEEN 64 AND 127 THEN '10.64.0.0/10' WHEN a = 10 THEN '10.0.0.0/8' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN '100.64.0.0/10' WHEN a = 172 AND b BETWEEN 16 AND 31 THEN '172.16.0.0/12'
        WHEN a = 192 AND b = 168 THEN '192.168.0.0/16' WHEN a >= 224 THEN '224.0.0.0/3' WHEN a >= 192 THEN '192.0.0.0/3' ELSE '0.0.0.0/0' END AS r4,
        CASE WHEN g = 8193 AND h = 3512 AND i BETWEEN 64 AND 95 THEN '2001:db8:40::/43' WHEN g = 8193 AND h = 3512 THEN '2001:db8::/32' WHEN g BETWEEN 64512 AND 65023 THEN 'fc00::/7' WHEN g BETWEEN 65152 AND 65215 THEN 'fe80::/10'
          WHEN g = 0 AND h = 0 AND i = 0 THEN '::/96' END AS r6 FROM t)
      SELECT c_custkey, v4 AS address, r4 AS cidr FROM four UNION ALL SELECT c_custkey, v6, r6 FROM four UNION ALL SELECT c_custkey, short, r6 FROM four
      UNION ALL SELECT c_custkey, '[::FFFF:' || v4 || ']', r4 FROM four UNION ALL SELECT c_custkey, v4 || '.' || v4, NULL FROM four""",
    "page_origins": r"""SELECT page_id, url AS absolute, url AS beside, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
      CASE page_id % 3 WHEN 0 THEN 'private address' WHEN 1 THEN 'private host' END AS refusal FROM pages""",
    "rate_limits_stream": AUDIT["rate_limits"],
}
