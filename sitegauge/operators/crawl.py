"""Whole sites: pages are discovered, audited and summed up, with the checks of a site as a whole on its first page only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import resolved
from sitegauge.operators import crawlers, discovery, page_checks, risk, robots, scoring, site_checks, site_issues
from sitegauge.operators.extraction import extract_pages, word_count
from sitegauge.sources.staging import staged

#: Pages of a site by default, and the name by which the crawl itself obeys robots.txt.
MOST_PAGES, AGENT = 25, "sitegauge"
FILE = "struct<status:int,content_type:string,text:string>"


@dataclass(frozen=True)
class Crawl:
    """Frames of a crawl of many sites.

    found: site, rank, url, source. pages: site, rank, url, status, score, title, description, h1, words, noindex, risk, flags. issues: site, issue, url, value.
    sites: site, source, found, blocked, offsite, crawled, average.
    """

    found: DataFrame
    pages: DataFrame
    issues: DataFrame
    sites: DataFrame


def start_links(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """site, ord, loc of the internal links of the start pages."""
    home = starts.join(pages.select("url", "html"), "url", "left").select(F.xxhash64("site", "url").alias("page_id"), "site", "url", "html")
    facts = extract_pages(home)
    return discovery.page_links(facts.select("page_id", "links")).join(home.select("page_id", "site"), "page_id").select("site", F.col("ord").cast("long").alias("ord"), "loc")


def in_one_spelling(pages: DataFrame) -> DataFrame:
    return pages.withColumn("url", F.coalesce(resolved(F.col("url"), fragment=False), F.col("url")))


def discover_sites(starts: DataFrame, site_files: DataFrame, sitemap_files: DataFrame, pages: DataFrame, most: int = MOST_PAGES, token: str = AGENT) -> tuple[DataFrame, DataFrame]:
    """The candidates of every site (see ``discovery.candidates``), and what their sitemaps list. Urls of ``pages`` are in one spelling."""
    starts = in_one_spelling(starts.select("site", "url").where("url is not null"))
    files = site_files.where("kind = 'robots'")
    texts = files.where(site_checks.is_text_file(F.col("status"), F.col("content_type"), F.col("text"))).select("site", "text")
    locs = discovery.expand_sitemaps(discovery.sitemap_starts(starts, robots.robots_sitemaps(texts)), sitemap_files, most)
    return discovery.candidates(starts, locs, start_links(starts, pages), robots.robots_rules(texts), token), locs


def crawl_sites(starts: DataFrame, site_files: DataFrame, sitemap_files: DataFrame, pages: DataFrame, most: int = MOST_PAGES, token: str = AGENT, variants: DataFrame | None = None) -> Crawl:
    """A crawl of every site of ``starts`` (site, url), of ``most`` pages each at most.

    ``site_files`` has site, kind (robots, llms, llms_full), status, content_type and text; ``sitemap_files`` has url, status and text; ``pages`` has page_id,
    url, status, html, ttfb_ms, headers and redirect_hops, one row for each url, whatever its spelling. ``variants`` are pages as other crawlers get them (see ``risk.variant_flags``). Only pages that the
    discovery finds are parsed, once. What AI crawlers find (robots and llms files, refusals, cloaking) is checked on the page of rank 1; all other pages have it skipped. A
    page that ``pages`` lacks has status 0 and no score. Sites without files are crawled by the links of their start page.
    """
    files = lambda kind: site_files.where(F.col("kind") == kind).select("site", "status", "content_type", "text")
    pages = in_one_spelling(pages)
    every, locs = discover_sites(starts, site_files, sitemap_files, pages, most, token)
    every = staged(every)
    found = discovery.capped(every, most)
    asked = staged(found.join(pages, "url", "left"))
    facts = staged(extract_pages(asked.where("page_id is not null")))
    checks = audited(asked, facts, files)
    own = staged(page_rows(asked, facts, checks, variants))
    listed = locs.select("site", resolved(F.col("loc"), fragment=False).alias("loc"))
    counts = own.groupBy("site").agg(F.count("*").alias("crawled"), scoring.half_up(F.avg(F.when((F.col("status") > 0) & (F.col("status") < 400), F.col("score")))).alias("average"))
    sites = discovery.discovery_reports(every).join(counts, "site", "left")
    return Crawl(found, own, issues(own, listed), sites.withColumns({"crawled": F.coalesce("crawled", F.lit(0)), "average": F.coalesce("average", F.lit(0))}))


def geo_rows(asked: DataFrame, facts: DataFrame, files: Callable[[str], DataFrame]) -> DataFrame:
    """Pages with their sites' files as ``site_checks.geo_checks`` reads them, enabled for the first page of a site."""
    ranks = asked.select("page_id", "site", "rank", "headers")
    report = crawlers.robots_report(files("robots"))
    counts = site_checks.crawler_counts(crawlers.access_table(report).select("site", "bot", "blocked"))
    sites = report.select("site", F.col("valid").alias("robots_ok"), F.size("groups").alias("robots_groups"), F.size("sitemaps").alias("sitemaps")).join(counts, "site")
    as_struct = lambda kind: files(kind).groupBy("site").agg(F.first(F.struct(F.col("status").cast("int").alias("status"), "content_type", "text")).alias(kind))
    rows = facts.join(ranks, "page_id").join(sites, "site", "left").join(as_struct("llms"), "site", "left").join(as_struct("llms_full"), "site", "left")
    return rows.withColumns({
        "robots_ok": F.coalesce("robots_ok", F.lit(False)), "robots_groups": F.coalesce("robots_groups", F.lit(0)), "sitemaps": F.coalesce("sitemaps", F.lit(0)),
        "blocked_search": F.coalesce("blocked_search", F.lit(0)), "blocked_training": F.coalesce("blocked_training", F.lit(0)), "probe_status": F.lit(None).cast("int"), "geo_enabled": F.col("rank") == 1,
    })


def audited(asked: DataFrame, facts: DataFrame, files: Callable[[str], DataFrame]) -> DataFrame:
    """page_id, module, check_id, status, severity of the pages' nine modules."""
    names = ("page_id", "module", "check_id", "status", "severity")
    unrendered = facts.limit(0).withColumns({"console_errors": F.array().cast("array<string>"), "redirects": F.array().cast("array<string>")})
    parts = [
        page_checks.page_checks(facts), site_checks.geo_checks(geo_rows(asked, facts, files)), site_checks.render_checks(facts, unrendered),
        site_checks.server_checks(asked.where("page_id is not null").select("page_id", "status", "ttfb_ms", "headers", "redirect_hops")),
    ]
    out = parts[0].select(*names)
    for more in parts[1:]:
        out = out.unionByName(more.select(*names))
    return out


def page_rows(asked: DataFrame, facts: DataFrame, checks: DataFrame, variants: DataFrame | None) -> DataFrame:
    flags = risk.page_flags(facts).select("page_id", "flag", "severity")
    if variants is not None:
        first = facts.join(asked.where("rank = 1").select("page_id", "status"), "page_id").select("page_id", "url", "status", F.col("visible_text").alias("text"), "title")
        flags = flags.unionByName(risk.variant_flags(first, variants).select("page_id", "flag", "severity"))
    flags = staged(flags)
    counts = flags.groupBy("page_id").agg(F.count("*").alias("flags"))
    status = risk.risk_status(facts, flags).withColumnRenamed("status", "risk")
    scores = scoring.overall_scores(scoring.module_scores(checks)).select("page_id", F.col("overall").alias("score"))
    one = F.size(F.filter("headings", lambda h: h["level"] == 1))
    noindex = F.coalesce(F.element_at("metas", "robots"), F.lit("")).contains("noindex")
    shown = facts.select("page_id", "title", F.element_at("metas", "description").alias("description"), one.alias("h1"), word_count("text").alias("words"), noindex.alias("noindex"))
    rows = asked.select("site", "rank", "url", F.coalesce("status", F.lit(0)).alias("status"), "page_id")
    for more in (scores, shown, status, counts):
        rows = rows.join(more, "page_id", "left")
    return rows.withColumn("flags", F.when(F.col("page_id").isNotNull(), F.coalesce("flags", F.lit(0)))).drop("page_id")


def issues(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """site, issue, url, value: the ten lists of a crawl's issues; value is what makes a page one, as text."""

    def named(issue: str, df: DataFrame, value: Column | None = None) -> DataFrame:
        return df.select("site", F.lit(issue).alias("issue"), "url", (F.lit(None) if value is None else value).cast("string").alias("value"))

    def repeated(issue: str, column: str) -> DataFrame:
        value = F.lower(F.trim(column))
        shared = site_issues.duplicate_values(pages, column).select("site", F.col("value").alias("shared"))
        return named(issue, site_issues.good_pages(pages).withColumn("shared", value).join(shared, ["site", "shared"]), F.col("shared"))

    risky = site_issues.good_pages(pages).where("risk <> 'clean'")
    parts = [
        named("error", site_issues.error_pages(pages), F.col("status")), repeated("duplicate_title", "title"), repeated("duplicate_description", "description"),
        named("missing_title", site_issues.missing_values(pages, "title")), named("missing_description", site_issues.missing_values(pages, "description")),
        named("h1", site_issues.h1_problems(pages), F.col("h1")), named("noindex_in_sitemap", site_issues.noindex_in_sitemap(pages, listed)),
        named("thin", site_issues.thin_pages(pages), F.col("words")), named("risky", risky, F.col("risk")), named("weakest", site_issues.weakest_pages(pages), F.col("score")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
