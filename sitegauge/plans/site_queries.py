"""Queries of whole audits: checks, flags, findings and files of pages with companion files, responses and renders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import text as tx
from sitegauge.operators import advice, business, comparisons, crawlers, page_checks, risk, scoring, site_checks, site_issues
from sitegauge.operators.extraction import extract_pages
from sitegauge.plans import fixtures as fx
from sitegauge.plans.site_oracles import ORACLES  # noqa: F401
from sitegauge.sources.tables import read_table


def pages(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url")


def facts(spark, sf_dir) -> DataFrame:
    return extract_pages(fx.variants(pages(spark, sf_dir)))


def llms_texts(spark, sf_dir) -> DataFrame:
    files = fx.files(pages(spark, sf_dir), fx.LLMS)
    return files.where(site_checks.is_text_file(F.col("status"), F.col("content_type"), F.col("text"))).select("page_id", "text")


def report(spark, sf_dir) -> DataFrame:
    return crawlers.robots_report(fx.files(pages(spark, sf_dir), fx.ROBOTS))


def risk_flags(spark, sf_dir):
    found = risk.page_flags(facts(spark, sf_dir))
    return found.select("page_id", "flag", "severity", F.col("rank").cast("long").alias("rank"), F.size("evidence").cast("long").alias("pieces"), F.element_at("evidence", 1)["text"].alias("first"))


def drafted_files(spark, sf_dir):
    """page_id, file, content of every file that can be drafted for a page."""
    own = facts(spark, sf_dir)
    known, origins = business.page_business(own), own.select("page_id", F.regexp_extract("url", "^(https://[^/]*)", 1).alias("origin"))
    named = lambda df, file: df.select("page_id", F.lit(file).alias("file"), "content")
    robots = crawlers.robots_file(report(spark, sf_dir)).select(F.col("site").cast("long").alias("page_id"), F.lit("robots").alias("file"), "content")
    texts = llms_texts(spark, sf_dir)
    drafts = business.llms_drafts(known.join(texts, "page_id", "left_anti"), origins)
    return (
        robots.unionByName(named(drafts, "llms"))
        .unionByName(named(business.repaired_llms(texts, known), "llms"))
        .unionByName(named(business.organisation_schema(known.where("organisations = 0"), origins), "schema_org"))
        .unionByName(named(business.repaired_schema(own), "schema_fixed"))
    )


def advice_summaries(spark, sf_dir):
    strong = advice.strengths(pages(spark, sf_dir).select(
        "page_id", (F.col("page_id") % 2 == 0).alias("robots_open"), F.lit(True).alias("rendered"), F.lit(False).alias("js_only"), (F.col("page_id") % 100).alias("raw_words"),
        (F.col("page_id") % 3).alias("blocks"), (F.col("page_id") % 5 == 0).alias("llms"), F.when(F.col("page_id") % 7 < 2, F.col("page_id") % 7).alias("sitemap_locs")))
    found = pages(spark, sf_dir).where("page_id % 4 > 0").select("page_id", F.explode(F.sequence(F.lit(1), F.col("page_id") % 4)).alias("rank"))
    found = found.select("page_id", F.concat(F.lit("f"), F.col("rank").cast("string")).alias("finding"), F.when((F.col("page_id") % 8 > 3) & (F.col("rank") < 3), "high").otherwise("low").alias("impact"), "rank")
    return advice.summaries(pages(spark, sf_dir), found, strong)


def address_texts(spark, sf_dir):
    """Text functions on the urls of pages."""
    url = F.col("url")
    bare = F.regexp_replace("url", "^https?://", "")
    parts = F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")
    return pages(spark, sf_dir).select(
        "page_id", tx.slug(url).alias("slug"), tx.normalized_url(bare).alias("normalized"), tx.path_of(url).alias("path"), tx.list_some(parts, 2, "part").alias("parts"),
        tx.decoded(F.concat(F.regexp_replace("url", "/", "%2F"), F.lit("+1"))).alias("decoded"), comparisons.property_name(bare).alias("property"), comparisons.property_name(url).alias("prefix"),
        comparisons.bare_host(url).alias("host"), comparisons.signed(F.col("page_id") % 3 - 1).alias("signed"),
    )


def quoted_turns(spark, sf_dir):
    """Conversation turns as quoted evidence, flattened and clipped."""
    rows = read_table(spark, sf_dir, "conversations")
    odd = F.concat(F.coalesce("text", F.lit("")), F.lit("​`a|b`‮\x07 end"))
    return rows.select("conv_id", "turn", "role", tx.flattened(odd).alias("flat"), tx.evidence(odd, 40).alias("evidence"), tx.name_from_title(F.concat_ws(" - ", "role", "text")).alias("last_part"))


def listings(spark, sf_dir):
    """Suppliers as listings: yours by name or website; phone keys; private addresses."""
    name, site = F.col("s_name"), F.concat(F.lit("https://www.shop"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".example/"))
    ip = F.concat_ws(".", *[((F.col("s_suppkey") * k) % 256).cast("string") for k in (7, 31, 3, 1)])
    return read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", comparisons.is_you(name, site, F.lit("supplier#000000007"), F.lit("shop4.example")).alias("you"), comparisons.business_name(name).alias("name"),
        tx.phone_key(F.concat(F.lit("+49 30 "), F.col("s_suppkey").cast("string"))).alias("phone"), tx.is_private_ip(ip).alias("private"),
    )


def score_matrix(spark, sf_dir):
    """Mean score of each module in each language of the pages."""
    rows = page_checks.page_checks(extract_pages(read_table(spark, sf_dir, "pages")))
    langs = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("site"))
    means = scoring.module_scores(rows).join(langs, "page_id").groupBy("site", "module").agg(scoring.half_up(F.avg("score")).alias("score"))
    return comparisons.score_matrix(means, ["de", "en", "es", "fr"])


def site_averages(spark, sf_dir):
    rows = page_checks.page_checks(extract_pages(read_table(spark, sf_dir, "pages")))
    sites = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"))
    return scoring.site_scores(scoring.overall_scores(scoring.module_scores(rows)), sites)


def crawl_issues(spark, sf_dir):
    """Orders as pages of their customers' sites: errors, missing titles, headings, noindex pages in sitemaps, and weakest pages."""
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("site"), F.concat(F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"), fx.pick((200, 404, 0, 301), (F.col("o_orderkey") % 4).cast("int")).alias("status"),
        F.when(F.col("o_orderkey") % 5 > 0, F.lit("t")).alias("title"), (F.col("o_orderkey") % 3).cast("int").alias("h1"), (F.col("o_orderkey") % 2 == 0).alias("noindex"), (F.col("o_orderkey") % 100).alias("score"),
    )
    locs = rows.where("substr(url, -1) = '8'").select("site", F.col("url").alias("loc"))
    named = lambda df, issue: df.select("site", "url", F.lit(issue).alias("issue"))
    return (
        named(site_issues.error_pages(rows), "error").unionByName(named(site_issues.missing_values(rows, "title"), "title")).unionByName(named(site_issues.h1_problems(rows), "h1"))
        .unionByName(named(site_issues.noindex_in_sitemap(rows, locs), "noindex")).unionByName(named(site_issues.weakest_pages(rows, 2), "weakest"))
    )


def map_changes(spark, sf_dir):
    """Parts as map queries: positions and reviews of two runs."""
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.col("p_size").alias("s"))
    now = rows.select("query", F.when(F.col("s") % 4 > 0, F.col("s") % 4).alias("position"), (F.col("s") % 3).alias("reviews"))
    before = rows.select("query", F.when(F.col("s") % 5 > 0, F.col("s") % 5).alias("position"), (F.col("s") % 2).alias("reviews"))
    return comparisons.map_changes(now, before)


def index_answers(spark, sf_dir):
    inner = F.struct(F.when(F.col("page_id") % 2 == 0, "PASS").alias("verdict"), F.lit("Crawled").alias("coverageState"), F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise("u").alias("userCanonical"))
    answer = F.to_json(F.struct(F.struct(inner.alias("indexStatusResult")).alias("inspectionResult")))
    return comparisons.index_status(pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("url"), answer.alias("answer"))).select("url", "verdict", "coverage", "user_canonical", "last_crawl")


def submitted(spark, sf_dir):
    content = lambda v: F.struct(v.cast("string").alias("submitted"))
    rows = pages(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") % 5).cast("string")).alias("errors"), F.lit("x").alias("warnings"),
        F.when(F.col("page_id") % 3 > 0, F.array(content(F.col("page_id")), content(F.lit("7")), content(F.lit(None)))).alias("contents"),
    )
    return comparisons.submitted_sitemaps(rows)


QUERIES = {
    f.__name__: f
    for f in (
        risk_flags, drafted_files, advice_summaries, address_texts, quoted_turns, listings, score_matrix,
        site_averages, crawl_issues, map_changes, index_answers, submitted,
    )
}
