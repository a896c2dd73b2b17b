"""The audit queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.functions import text as tx
from sitegauge.operators import advice, comparisons, limits, page_checks, risk, robots, scoring, site_issues
from sitegauge.operators.extraction import extract_pages, word_count
from sitegauge.plans.audit_oracles import ORACLES  # noqa: F401
from sitegauge.sources.tables import read_table

TODAY = date(2024, 1, 30)
CORE = (
    "title.present", "title.length", "h1.present", "html.lang", "charset.present", "links.internal", "dom.text_html_ratio", "dom.word_count",
    "eeat.https", "eeat.thin_content", "headings.h1", "viewport.present", "canonical.present",
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def host() -> Column:
    return F.regexp_extract("url", "://([^/?#]*)", 1)


def page_facts(spark, sf_dir):
    one = F.size(F.filter("headings", lambda h: h["level"] == 1))
    return facts(spark, sf_dir).select(
        "page_id", "title", "lang", "charset", "has_doctype", one.alias("h1"), F.size("links").alias("links"), word_count("text").alias("words"),
        F.char_length("text").alias("text_chars"), "html_bytes",
    )


def all_checks(spark, sf_dir):
    return page_checks.page_checks(facts(spark, sf_dir))


def core_checks(spark, sf_dir):
    return all_checks(spark, sf_dir).where(F.col("check_id").isin(*CORE)).select("page_id", "module", "check_id", "status", "severity")


def module_scores(spark, sf_dir):
    return scoring.module_scores(all_checks(spark, sf_dir))


def overall_scores(spark, sf_dir):
    return scoring.overall_scores(module_scores(spark, sf_dir))


def core_scores(spark, sf_dir):
    return scoring.overall_scores(scoring.module_scores(core_checks(spark, sf_dir)))


def core_counts(spark, sf_dir):
    return scoring.severity_counts(core_checks(spark, sf_dir))


def recommendations(spark, sf_dir):
    return scoring.recommendations(all_checks(spark, sf_dir), top=5)


def core_recommendations(spark, sf_dir):
    return scoring.recommendations(core_checks(spark, sf_dir))


def site_pages(spark, sf_dir):
    one = F.size(F.filter("headings", lambda h: h["level"] == 1))
    return facts(spark, sf_dir).select(host().alias("site"), "url", F.lit(200).alias("status"), "title", one.alias("h1"), word_count("text").alias("words"))


def duplicate_titles(spark, sf_dir):
    return site_issues.duplicate_values(site_pages(spark, sf_dir), "title")


def thin_pages(spark, sf_dir):
    return site_issues.thin_pages(site_pages(spark, sf_dir))


def gap_report(spark, sf_dir):
    """The host with the most pages against all others, each over all its pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", host().alias("site"))
    you = pages.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").first()
    sites = comparisons.site_checks(core_checks(spark, sf_dir).join(pages, "page_id"))
    return comparisons.gap_report(sites, you["site"] if you else "").withColumn("rank", F.col("rank").cast("long"))


def page_flags(spark, sf_dir):
    return risk.page_flags(facts(spark, sf_dir)).select("page_id", "flag", "severity", F.col("rank").cast("long").alias("rank"))


def top_terms(spark, sf_dir):
    return risk.top_terms(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def keyword_stuffing(spark, sf_dir):
    return risk.keyword_stuffing(top_terms(spark, sf_dir))


def ai_addresses(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", risk.addresses_ai(F.col("text")).alias("addresses_ai"))


def turn_similarity(spark, sf_dir):
    """Word similarity of each turn with the one before it."""
    rows = read_table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    both = rows.select("conv_id", "turn", "text", before.alias("b")).where("b is not null")
    return both.select("conv_id", "turn", F.round(tx.jaccard(tx.word_set(F.col("text")), tx.word_set(F.col("b"))), 6).alias("similarity"))


def text_summaries(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.truncated(F.col("text"), 60).alias("summary"), tx.byte_size(F.octet_length("text")).alias("size"))


#: Rules that the robots queries meet urls with.
ROBOTS = (
    "# made up\nDisallow: /drafts\nUser-agent: *\nDisallow: /*?utm_\nAllow: /en/\nDisallow: /en/1*\nDisallow: /de/\nDisallow: /*.html$\nSitemap: https://a.example/map.xml\n"
    "User-agent: GPTBot\nUser-agent: CCBot # two\nDisallow: /\nUser-agent: ClaudeBot\nDisallow: /*\nAllow: /\n"
)
BOTS = ("OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Claude-SearchBot", "GPTBot", "ClaudeBot", "CCBot", "anthropic-ai", "Bytespider", "Google-Extended", "Applebot-Extended")


def robots_files(spark, sf_dir):
    sites = read_table(spark, sf_dir, "pages").select(host().alias("site")).distinct()
    return sites.withColumn("text", F.lit(ROBOTS))


def robots_rules(spark, sf_dir):
    return robots.robots_rules(robots_files(spark, sf_dir)).select("site", F.col("group_no").cast("long").alias("group_no"), "agent", "type", "path")


def crawler_access(spark, sf_dir):
    files = robots_files(spark, sf_dir)
    bots = spark.createDataFrame([(b,) for b in BOTS], "bot string")
    return robots.crawler_access(robots.robots_rules(files), bots, files)


def urls_allowed(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    urls = read_table(spark, sf_dir, "pages").select(host().alias("site"), "url", path.alias("path")).distinct()
    return robots.urls_allowed(urls, robots.robots_rules(robots_files(spark, sf_dir))).select("site", "url", "allowed")


def hits(spark, sf_dir):
    """Events as search metrics: views are impressions, clicks are clicks, the value is a position."""
    rows = read_table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    by = rows.groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day"))
    return by.agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("impressions"), F.sum(F.col("value").cast("decimal(18,6)")).alias("weighted_position"))


def search_performance(spark, sf_dir):
    now, before = comparisons.periods(TODAY, 10)
    out = comparisons.period_metrics(hits(spark, sf_dir), now, before, "key")
    return out.select("key", "clicks", "impressions", F.round("ctr", 6).alias("ctr"), F.round("position", 4).alias("position"), "clicks_change", "position_change", "new")


def search_totals(spark, sf_dir):
    return comparisons.period_totals(hits(spark, sf_dir), *comparisons.periods(TODAY, 10))


def positions(spark, sf_dir, period):
    days = F.col("day").between(*[F.lit(d) for d in period])
    return hits(spark, sf_dir).where(days).groupBy("key").agg(F.floor(F.sum("weighted_position").cast("double") / F.sum("impressions")).alias("position"))


def rank_changes(spark, sf_dir):
    now, before = comparisons.periods(TODAY, 4)
    return comparisons.rank_changes(positions(spark, sf_dir, now), positions(spark, sf_dir, before))


def active_changes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    now, before = comparisons.periods(TODAY, 2)
    side = lambda p: rows.where(F.col("day").between(*[F.lit(d) for d in p]))
    return comparisons.set_changes(side(now), side(before), ["user_id", "event_type"], "good", "warn")


def score_moves(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value")).cast("long").alias("avg_score"))
    return comparisons.score_moves(rows, "event_type", "day").withColumn("day", F.col("day").cast("string"))


def latest_events(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return comparisons.latest_before(rows, ["user_id", "event_type"], "ts", TODAY).select("user_id", "event_type", "event_id")


def local_results(spark, sf_dir):
    """Suppliers as the listings of their nation: balances give reviews, every seventh is yours."""
    rows = read_table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("query"), F.col("s_suppkey").alias("ord"), F.floor(F.abs("s_acctbal") % 40).alias("reviews"),
        F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("website"), (F.col("s_suppkey") % 7 == 0).alias("you"),
    )
    return comparisons.local_results(rows).withColumn("position", F.col("position").cast("long"))


def rate_limits(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at"))
    return limits.rate_limited(rows, "user_id", "at", 2, 86_400)


def findings(spark, sf_dir):
    return advice.findings(all_checks(spark, sf_dir))


def core_findings(spark, sf_dir):
    return advice.findings(core_checks(spark, sf_dir))


def core_snippets(spark, sf_dir):
    return advice.fix_snippets(core_checks(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        page_facts, core_checks, module_scores, overall_scores, core_scores, core_counts, recommendations, core_recommendations, duplicate_titles, thin_pages,
        gap_report, page_flags, top_terms, keyword_stuffing, ai_addresses, turn_similarity, text_summaries, robots_rules, crawler_access, urls_allowed,
        search_performance, search_totals, rank_changes, active_changes, score_moves, latest_events, local_results, rate_limits,
        findings, core_findings, core_snippets,
    )
} | {"page_checks": lambda spark, sf_dir: all_checks(spark, sf_dir).drop("value")}

