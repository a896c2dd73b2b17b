"""Queries of structured data that is made of customers and their orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.operators import business, page_checks, structured
from sitegauge.operators.extraction import extract_pages
from sitegauge.plans.audit_oracles import FACTS
from sitegauge.sources.tables import read_table


def blocks(spark, sf_dir) -> DataFrame:
    """c_custkey, text: a person with a country and orders, each with a seller. Every tenth text breaks off before its end."""
    own, kind = read_table(spark, sf_dir, "customer"), lambda t: F.lit(t).alias("@type")
    seller = F.struct(kind("Organization"), F.col("o_orderpriority").alias("name"))
    date = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("startDate")
    order = F.struct(F.array(F.lit("Order"), F.lit("http://schema.org/Event")).alias("@type"), F.col("o_orderkey").cast("string").alias("orderNumber"), F.col("o_orderstatus").alias("name"), date, seller.alias("seller"))
    orders = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(order).alias("owns"))
    country = F.struct(kind("https://schema.org/Country"), F.col("n_name").alias("name")).alias("nationality")
    name = F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise("").alias("name")
    joined = own.join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, "c_custkey", "left")
    text = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), kind("Person"), name, country, "owns"))
    return joined.select("c_custkey", F.when(F.col("c_custkey") % 10 == 3, F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text).alias("text"))


def typed_nodes(spark, sf_dir):
    """How many nodes of each types stand at each level of each block."""
    found = structured.nodes(structured.walk(blocks(spark, sf_dir), "c_custkey", "text").values)
    return found.groupBy(F.col("block").alias("c_custkey"), F.col("level").cast("long").alias("level"), F.array_join("types", ",").alias("types")).agg(F.count("*").alias("nodes"))


def lacking_fields(spark, sf_dir):
    """How many nodes of each block lack a field that their type needs."""
    found = structured.missing_fields(structured.nodes(structured.walk(blocks(spark, sf_dir), "c_custkey", "text").values))
    return found.groupBy(F.col("block").alias("c_custkey"), "type", "field").agg(F.count("*").alias("nodes"))


def block_strings(spark, sf_dir):
    """Strings and their characters of each block; of a broken one none."""
    walked = structured.walk(blocks(spark, sf_dir), "c_custkey", "text")
    found = structured.strings(walked.values).groupBy("block").agg(F.count("*").alias("strings"), F.sum(F.char_length("text")).alias("chars"), F.lit(False).alias("broken"))
    zero = F.lit(0).cast("long")
    return found.unionByName(walked.broken.select("block", zero.alias("strings"), zero.alias("chars"), F.lit(True).alias("broken"))).withColumnRenamed("block", "c_custkey")


def marked_html(spark, sf_dir) -> DataFrame:
    """The pages with blocks in their heads, made of their own hosts, addresses and titles: none, an organisation with a question, a product with a trail, and a broken one."""
    pages, i = read_table(spark, sf_dir, "pages"), F.col("page_id")
    site, title = F.regexp_extract("url", "://([^/?#]*)", 1), F.trim(F.replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&")))
    kind = lambda t: F.lit(t).alias("@type")
    question = F.struct(kind("FAQPage"), F.array(F.struct(kind("Question"), title.alias("name"))).alias("mainEntity"))
    address = F.struct(F.concat(i.cast("string"), F.lit(" Main St")).alias("streetAddress"), F.lit("Berlin").alias("addressLocality"))
    organisation = F.struct(
        kind("Organization"), site.alias("name"), F.col("url"), F.concat(F.lit("+49 30 "), (i + 1_000_000).cast("string")).alias("telephone"), F.concat(F.lit("mailto:Info@"), site).alias("email"), address.alias("address"),
        F.array(F.concat(F.lit("https://social.example/"), site)).alias("sameAs"), F.array(F.lit("DE"), F.lit("France")).alias("areaServed"), F.array(question).alias("department"),
    )
    product = F.struct(kind("Product"), F.when(i % 3 == 0, "Nowhere to be seen").otherwise(title).alias("name"))
    trail = F.concat(F.lit("["), F.to_json(product), F.lit(', {"@type": "BreadcrumbList"}]'))
    block = lambda text: F.concat(F.lit('<script type="application/ld+json">'), text, F.lit("</script>"))
    more = F.when(i % 8 == 3, block(F.lit('{"@type": "Person", "name": ""}'))).otherwise("")
    blocks = F.when(i % 4 == 1, block(F.to_json(organisation))).when(i % 4 == 2, block(trail)).when(i % 4 == 3, F.concat(block(F.lit('{"@type": "Product"')), more)).otherwise("")
    return pages.select("page_id", "url", F.replace("html", F.lit("</head>"), F.concat(blocks, F.lit("</head>"))).alias("html"))


def marked_up(spark, sf_dir) -> DataFrame:
    return extract_pages(marked_html(spark, sf_dir))


def structured_data_checks(spark, sf_dir):
    found = page_checks.page_checks(marked_up(spark, sf_dir)).where("module = 'schema_rich'")
    return found.select("page_id", "check_id", "status", "severity", F.coalesce("value", F.lit("")).alias("value"))


def business_facts(spark, sf_dir):
    """What the pages' blocks say of the businesses behind them."""
    joined = lambda c: F.array_join(c, "|").alias(c)
    known = business.page_business(marked_up(spark, sf_dir))
    return known.select("page_id", "name", joined("phones"), joined("emails"), "address", joined("same_as"), joined("areas"), F.col("organisations").cast("long").alias("organisations"))


QUERIES = {f.__name__: f for f in (typed_nodes, lacking_fields, block_strings, structured_data_checks, business_facts)}

WHOLE = """c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 3),
o AS (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS undated, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderstatus) + length(o_orderpriority)) AS BIGINT) AS chars FROM orders GROUP BY 1)"""
ORACLES = {
    "typed_nodes": f"""WITH {WHOLE} SELECT c_custkey, 0::BIGINT AS level, 'Person' AS types, 1::BIGINT AS nodes FROM c UNION ALL SELECT c_custkey, 1, 'Country', 1 FROM c
      UNION ALL SELECT c_custkey, 2, 'Order,Event', n FROM c JOIN o USING (c_custkey) UNION ALL SELECT c_custkey, 3, 'Organization', n FROM c JOIN o USING (c_custkey)""",
    "lacking_fields": f"""WITH {WHOLE} SELECT c_custkey, 'Person' AS type, 'name' AS field, 1::BIGINT AS nodes FROM c WHERE name = '' UNION ALL SELECT c_custkey, 'Event', 'location', n FROM c JOIN o USING (c_custkey)
      UNION ALL SELECT c_custkey, 'Event', 'startDate', undated FROM c JOIN o USING (c_custkey) WHERE undated > 0 UNION ALL SELECT c_custkey, 'Organization', 'url', n FROM c JOIN o USING (c_custkey)""",
    "structured_data_checks": f"""WITH {FACTS},
      own AS (SELECT page_id, page_id % 4 AS k, page_id % 4 = 1 OR page_id % 4 = 2 OR page_id % 8 = 3 AS there, regexp_matches(text, '(?i)\\b(faq|frequently asked questions|q&a)\\b') AS asks,
        title <> '' AND NOT contains(lower(text), lower(title)[1:20]) AS untold, page_id % 3 = 0 AND NOT contains(lower(text), 'nowhere to be seen') AS unseen FROM f),
      s AS (SELECT page_id, unnest([
        {{'k': 'syntax', 'o': CASE k WHEN 0 THEN 'skip' WHEN 3 THEN 'critical' ELSE 'pass' END, 'v': CASE k WHEN 3 THEN '1' ELSE '0' END}}, {{'k': 'present', 'o': CASE WHEN there THEN 'pass' ELSE 'warning' END, 'v': ''}},
        {{'k': 'types', 'o': CASE WHEN there THEN 'pass' END, 'v': CASE k WHEN 1 THEN 'FAQPage,Organization,Question' WHEN 2 THEN 'BreadcrumbList,Product' ELSE 'Person' END}},
        {{'k': 'primary_entity', 'o': CASE WHEN NOT there THEN NULL WHEN k = 3 THEN 'warning' ELSE 'pass' END, 'v': ''}},
        {{'k': 'required_fields', 'o': CASE WHEN NOT there THEN NULL WHEN k = 1 THEN 'pass' ELSE 'warning' END, 'v': CASE k WHEN 1 THEN '' WHEN 2 THEN CASE WHEN nameless THEN 'Product.name,' ELSE '' END || 'Product.offers,BreadcrumbList.itemListElement' ELSE 'Person.name' END}},
        {{'k': 'entity_match', 'o': CASE WHEN NOT there THEN NULL WHEN k = 1 AND untold OR k = 2 AND (unseen OR page_id % 3 > 0 AND untold) THEN 'warning' ELSE 'pass' END,
          'v': CASE WHEN k = 1 AND untold THEN 'questions' WHEN k = 2 AND (unseen OR page_id % 3 > 0 AND untold) THEN 'name' ELSE '' END}},
        {{'k': 'breadcrumb', 'o': CASE WHEN NOT there THEN NULL WHEN k = 2 THEN 'pass' ELSE 'notice' END, 'v': ''}}, {{'k': 'faq', 'o': CASE WHEN NOT there THEN NULL WHEN k = 1 THEN 'pass' WHEN asks THEN 'notice' ELSE 'skip' END, 'v': ''}}]) AS r
        FROM own JOIN (SELECT page_id, page_id % 3 > 0 AND title = '' AS nameless FROM f) USING (page_id))
      SELECT page_id, 'schema.' || r.k AS check_id, CASE WHEN r.o IN ('critical', 'warning', 'notice') THEN 'fail' ELSE r.o END AS status, CASE WHEN r.o IN ('critical', 'warning', 'notice') THEN r.o ELSE 'info' END AS severity, r.v AS value FROM s WHERE r.o IS NOT NULL""",
    "business_facts": f"""WITH {FACTS}, n AS (SELECT page_id, site, page_id % 4 = 1 AS own, list_filter(list_transform(string_split_regex(title, '\\s[|–—-]\\s|\\s·\\s'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM f)
      SELECT page_id, CASE WHEN own THEN site WHEN len(parts) > 1 THEN parts[-1] ELSE regexp_replace(site, '^www\\.', '') END AS name, CASE WHEN own THEN '+49 30 ' || (page_id + 1000000) ELSE '' END AS phones,
        CASE WHEN own THEN 'info@' || site ELSE '' END AS emails, CASE WHEN own THEN page_id || ' Main St, Berlin' END AS address, CASE WHEN own THEN 'https://social.example/' || site ELSE '' END AS same_as,
        CASE WHEN own THEN 'DE|France' ELSE '' END AS areas, CAST(own AS BIGINT) AS organisations FROM n""",
    "block_strings": f"""WITH {WHOLE} SELECT c_custkey, 5 + coalesce(7 * n - undated, 0) AS strings,
        length('https://schema.org') + length('Person') + length(name) + length('https://schema.org/Country') + length(n_name)
          + coalesce(n * (length('Order') + length('http://schema.org/Event') + length('Organization')) + chars + 10 * (n - undated), 0) AS chars, FALSE AS broken
      FROM c LEFT JOIN o USING (c_custkey) UNION ALL SELECT c_custkey, 0, 0, TRUE FROM customer WHERE c_custkey % 10 = 3""",
}
