"""Rule checks that need more than a page's HTML: responses, companion files, crawlers' access, renders.

Each function takes one row per page and gives checks in the form of ``page_checks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.operators.extraction import word_count
from sitegauge.operators.page_checks import C, N, W, check, checks_of, many, meta

#: What challenge pages of bot walls say.
BOT_WALLS = ("just a moment", "attention required! | cloudflare", "enable javascript and cookies to continue", "cf-browser-verification", "__cf_chl_")
#: Crawlers that answer questions, and crawlers that gather training data.
SEARCH_BOTS = ("OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Claude-SearchBot", "Google-Extended")
TRAINING_BOTS = ("GPTBot", "ClaudeBot", "CCBot", "anthropic-ai", "Bytespider", "Applebot-Extended")


def header(name: str) -> Column:
    return F.coalesce(F.element_at("headers", name), F.lit(""))


def server_checks(fetches: DataFrame) -> DataFrame:
    """Checks of responses: page_id, status, ttfb_ms, headers (lower-case names), redirect_hops."""
    m = "server_security"
    hops = F.coalesce("redirect_hops", F.lit(0))
    status, age = F.coalesce("status", F.lit(0)), F.expr("try_cast(regexp_extract(element_at(headers, 'strict-transport-security'), '(?i)max-age=([0-9]+)', 1) AS bigint)")
    return checks_of(fetches, [
        check(m, "server.status", (status.between(300, 399), W), (~status.between(200, 299), C), value=status),
        check(m, "server.ttfb", (F.col("ttfb_ms") < 800, None), (F.col("ttfb_ms") < 1800, W), (F.lit(True), C), value=F.col("ttfb_ms")),
        check(m, "server.x_robots_tag", (header("x-robots-tag").rlike("(?i)noindex"), C)),
        check(m, "server.link_canonical", (~header("link").rlike("(?i)rel=\"?canonical"), "skip")),
        check(m, "server.protocol", (~header("alt-svc").contains("h3"), "skip")),
        check(m, "server.compression", (~header("content-encoding").rlike("(?i)br|gzip|zstd"), N)),
        check(m, "server.csp", (header("content-security-policy") == "", N)),
        check(m, "server.hsts", (age.isNull(), W), (age < 31_536_000, N)),
        check(m, "server.xcto", (~header("x-content-type-options").rlike("(?i)nosniff"), N)),
        check(m, "server.referrer_policy", (header("referrer-policy") == "", N)),
        check(m, "server.permissions_policy", (header("permissions-policy") == "", N)),
        check(m, "server.redirect_hops", (hops >= 2, N), value=hops),
    ])


def is_text_file(status: Column, content_type: Column, text: Column) -> Column:
    """A fetched companion file that is no HTML page in disguise."""
    head = F.lower(F.ltrim(F.coalesce(text, F.lit(""))))
    html = F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html") | head.startswith("<!doctype") | head.startswith("<html")
    return F.coalesce((status == 200) & (F.trim(F.coalesce(text, F.lit(""))) != "") & ~html, F.lit(False))


def crawler_counts(access: DataFrame) -> DataFrame:
    """site, blocked_search, blocked_training of a crawler access table."""
    blocked = lambda bots: F.count_if(F.col("blocked") & F.col("bot").isin(*bots))
    return access.groupBy("site").agg(blocked(SEARCH_BOTS).alias("blocked_search"), blocked(TRAINING_BOTS).alias("blocked_training"))


def geo_checks(rows: DataFrame) -> DataFrame:
    """Checks of what AI crawlers find.

    Rows hold facts of a page (html, metas, tags, text), headers, llms and llms_full (structs of status,
    content_type, text), robots_ok, robots_groups, sitemaps, blocked_search, blocked_training, probe_status and
    geo_enabled. Where that is false, the one check is geo.enabled, skipped.
    """
    m = "geo_ai_validator"
    llms = is_text_file(F.col("llms.status"), F.col("llms.content_type"), F.col("llms.text"))
    says = lambda p: F.coalesce(F.col("llms.text"), F.lit("")).rlike(p)
    no_robots, on = ~F.col("robots_ok"), F.col("geo_enabled")
    probe = F.col("probe_status")
    walls = F.lower(F.coalesce("html", F.lit("")))
    shapes = (
        F.col("text").rlike(r"(?i)\b(faq|frequently asked questions|q&a)\b").cast("int") + F.lower("html").rlike("<ul|<ol").cast("int") + F.lower("html").contains("<table").cast("int")
    )
    walled = F.lit(False)
    for wall in BOT_WALLS:
        walled = walled | walls.contains(wall)
    off = (~on, "absent")
    return checks_of(rows, [
        check(m, "geo.enabled", (on, "absent"), (F.lit(True), "skip")),
        check(m, "llms_txt.present", off, (~llms, W)),
        check(m, "llms_txt.h1", off, (~llms, "skip"), (~says(r"(?m)^#\s+.+"), N)),
        check(m, "llms_txt.summary", off, (~llms, "skip"), (~says(r"(?m)^>\s+.+"), N)),
        check(m, "llms_txt.links", off, (~llms, "skip"), (~says(r"\[.+\]\(.+\)"), N)),
        check(m, "llms_txt.markdown", off, (~llms, "skip"), (~says(r"(^|\n)#\s") & ~says(r"\[.+\]\(.+\)"), W)),
        check(m, "llms_full.present", off, (~is_text_file(F.col("llms_full.status"), F.col("llms_full.content_type"), F.col("llms_full.text")), N)),
        check(m, "robots.ai_search_bots", off, (no_robots, C), (F.col("blocked_search") >= 3, C), (F.col("blocked_search") >= 1, W), value=F.col("blocked_search")),
        check(m, "robots.ai_training_bots", off, (no_robots, "skip"), ((F.col("blocked_training") == 0) & (F.col("robots_groups") == 0), N), value=F.col("blocked_training")),
        check(m, "robots.sitemap", off, (no_robots, "skip"), (F.col("sitemaps") == 0, W)),
        check(m, "geo.bot_wall", off, (walled, C)),
        check(m, "geo.noai", off, (meta("noai").isNotNull() | meta("noimageai").isNotNull(), W)),
        check(m, "geo.x_robots_tag_ai", off, (header("x-robots-tag").rlike("(?i)noai|noimageai"), W)),
        check(m, "geo.ai_probe", off, (probe.isNull(), "skip"), (probe == 0, C), (probe.isin(403, 429), C), (~probe.between(200, 299), W), value=probe),
        check(m, "geo.chunkability", off, (shapes < 2, N), value=shapes),
    ])


def render_checks(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """Checks of a page's facts before and after rendering; ``rendered`` also has console_errors and redirects.

    A page without a render gives the one check diff.available, skipped.
    """
    m = "js_render_diff"
    names = ["title", "canonical", "headings", "links", "metas", "text", "node_count", "html_bytes"]
    left = raw.select("page_id", "tags", *[F.col(n).alias(f"raw_{n}") for n in names], word_count("text").alias("raw_words"))
    right = rendered.select("page_id", *names, word_count("text").alias("words"), "console_errors", "redirects", F.lit(True).alias("there"))
    both = left.join(right, "page_id", "left").withColumn("there", F.col("there").isNotNull())
    there = F.col("there")
    inside = lambda c: many(c, lambda x: x["internal"] & ~x["is_anchor"])
    firsts = lambda c: many(c, lambda h: h["level"] == 1)
    words, before = F.col("words"), F.col("raw_words")
    differ = (
        ~F.col("title").eqNullSafe(F.col("raw_title")) | ~F.col("canonical").eqNullSafe(F.col("raw_canonical")) | (firsts("headings") != firsts("raw_headings"))
        | ~F.element_at("metas", "robots").eqNullSafe(F.element_at("raw_metas", "robots"))
        | ~F.element_at("metas", "description").eqNullSafe(F.element_at("raw_metas", "description"))
    )
    hops = F.col("redirects")
    distinct_hops = F.size(F.filter(hops, lambda x, i: (i == 0) | (x != F.get(hops, i - 1))))
    growth = F.col("html_bytes") - F.col("raw_html_bytes")
    shell = ((F.char_length("raw_text") < 120) | (before < 20)) & (F.col("raw_node_count") < 60) & (words > 150)
    none = (~there, "absent")
    return checks_of(both, [
        check(m, "diff.available", (there, "absent"), (F.lit(True), "skip")),
        check(m, "diff.spa_shell", none, (shell, C)),
        check(m, "diff.content", none, ((words > 50) & (before / words < 0.25), C), (words - before > 100, W), value=words - before),
        check(m, "diff.critical_tags", none, (differ, C)),
        check(m, "diff.links", none, ((inside("links") > 5) & (inside("raw_links") < 3), C), (inside("links") - inside("raw_links") > 20, W)),
        check(m, "diff.headings", none, ((F.size("headings") > 0) & (F.size("raw_headings") == 0), W)),
        check(m, "diff.payload", none, ((F.col("html_bytes") > 3 * F.col("raw_html_bytes")) & (growth > 100_000), W), value=growth),
        check(m, "diff.noscript", none, (F.element_at("tags", "noscript").isNull() & (words > 200), N)),
        check(m, "diff.js_errors", none, (F.size("console_errors") > 5, C), (F.size("console_errors") > 0, W)),
        check(m, "diff.redirect_chain", none, (distinct_hops > 3, W), value=distinct_hops),
    ])
