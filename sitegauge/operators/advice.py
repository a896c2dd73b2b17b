"""Findings in plain words from failed checks, ranked for each page, and the snippets that fix them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.text import truncated

IMPACT_RANK = {"high": 3, "medium": 2, "low": 1}
#: Order of areas' tiers.
AREAS = ("access", "render", "facts", "schema", "llms", "meta", "content", "other")
#: Finding, checks of which any must fail, finding that replaces it, impact, effort, area.
FINDINGS = (
    ("page.noindex", ("robots.noindex", "server.x_robots_tag"), None, "high", "small", "access"),
    ("geo.bot_wall", ("geo.bot_wall",), None, "high", "medium", "access"),
    ("render.links", ("diff.links",), None, "medium", "medium", "render"),
    ("schema.invalid", ("schema.syntax",), None, "high", "small", "schema"),
    ("schema.missing", ("schema.present",), None, "high", "small", "schema"),
    ("schema.required_fields", ("schema.required_fields",), None, "low", "small", "schema"),
    ("llms.missing", ("llms_txt.present",), None, "medium", "small", "llms"),
    ("llms.format", ("llms_txt.summary", "llms_txt.links"), None, "low", "small", "llms"),
    ("meta.title_missing", ("title.present",), None, "high", "small", "meta"),
    ("meta.title_length", ("title.length",), "meta.title_missing", "low", "small", "meta"),
    ("meta.description_missing", ("meta_description.present",), None, "medium", "small", "meta"),
    ("meta.description_length", ("meta_description.length",), "meta.description_missing", "low", "small", "meta"),
    ("meta.h1", ("h1.present", "headings.h1"), None, "low", "small", "meta"),
    ("meta.canonical", ("canonical.present",), None, "low", "small", "meta"),
    ("meta.alt", ("images.alt",), None, "low", "small", "meta"),
    ("content.thin", ("eeat.thin_content",), None, "medium", "large", "content"),
)
#: Checks that findings above or of other inputs cover.
COVERED = {c for _, checks, *_ in FINDINGS for c in checks} | {
    "robots.ai_search_bots", "robots.ai_training_bots", "robots.sitemap", "diff.spa_shell", "diff.content", "schema.primary_entity", "llms_txt.h1",
    "llms_txt.markdown", "eeat.contact_info", "server.status", "scoring.critical_count", "scoring.overall",
}
#: Impact, effort and area of other checks, where they differ from the defaults.
OVERRIDES = {
    "viewport.present": ("high", "small", "meta"), "html.lang": ("low", "small", "meta"), "og.complete": ("low", "small", "meta"),
    "social.image_reachable": ("low", "small", "meta"), "twitter.card": ("low", "small", "meta"), "server.compression": ("low", "small", None),
    "server.protocol": (None, "small", None), "server.redirect_hops": (None, "small", None), "eeat.https": ("high", "small", "access"),
    "cwv.blocking_scripts": (None, "small", None), "cwv.lcp_lazy": (None, "small", None), "cwv.image_dims": (None, "small", None),
    "diff.js_errors": (None, None, "render"), "diff.headings": (None, None, "render"), "diff.critical_tags": (None, None, "render"),
    "diff.redirect_chain": (None, "small", None), "dom.duplicate_ids": ("low", "small", None), "links.internal": (None, None, "content"),
    "links.broken_external": (None, "small", None), "headings.hierarchy": ("low", "small", "meta"), "geo.noai": (None, "small", "access"),
    "geo.x_robots_tag_ai": (None, "small", "access"), "schema.entity_match": (None, "small", "schema"),
}
#: The snippet that a failed check asks for.
SNIPPETS = {
    "title": ("title.present", "title.length"), "description": ("meta_description.present", "meta_description.length"), "canonical": ("canonical.present",),
    "open_graph": ("og.complete",), "twitter": ("twitter.card",), "llms": ("llms_txt.present", "llms_txt.h1", "llms_txt.summary"), "favicon": ("favicon.present",),
    "schema": ("schema.present", "schema.primary_entity"), "lcp": ("cwv.lcp_fetchpriority", "cwv.lcp_lazy"), "scripts": ("cwv.blocking_scripts",),
    "iframes": ("dom.iframe_dims", "cwv.iframe_dims"), "trust": ("eeat.trust_links",),
}


def findings(checks: DataFrame, by: str = "page_id", more: DataFrame | None = None) -> DataFrame:
    """by, finding, impact, effort, area, rank: high impact first, then by area, then in order of the rules.

    A page's failed checks are gathered once; no check meets more than one small dimension of rules. ``more``
    (by, finding, impact, effort, area) are findings of other inputs, as of ``page_findings``, robots and business facts.
    """
    spark = checks.sparkSession
    failed = checks.where("status = 'fail'").select(by, "check_id", "severity")
    rules = [(f, c, r, i, e, a, n) for n, (f, checks_, r, i, e, a) in enumerate(FINDINGS) for c in checks_]
    table = spark.createDataFrame(rules, "finding string, check_id string, unless string, impact string, effort string, area string, ord int")
    named = failed.join(F.broadcast(table), "check_id").drop("check_id", "severity").distinct()
    first = named.select(by, F.col("finding").alias("unless"))
    named = named.join(first, [by, "unless"], "left_anti").drop("unless")
    overrides = spark.createDataFrame([(c, *o) for c, o in OVERRIDES.items()], "check_id string, i string, e string, a string")
    other = failed.where(F.col("severity").isin("critical", "warning") & ~F.col("check_id").isin(*sorted(COVERED))).join(F.broadcast(overrides), "check_id", "left")
    usual = F.when(F.col("severity") == "critical", "medium").otherwise("low")
    other = other.select(
        by, F.concat(F.lit("engine."), "check_id").alias("finding"), F.coalesce("i", usual).alias("impact"), F.coalesce("e", F.lit("medium")).alias("effort"),
        F.coalesce("a", F.lit("other")).alias("area"), F.lit(len(FINDINGS)).alias("ord"),
    ).distinct()
    rows = named.select(by, "finding", "impact", "effort", "area", "ord").unionByName(other)
    if more is not None:
        rows = rows.unionByName(more.select(by, "finding", "impact", "effort", "area", F.lit(0).alias("ord")))
    tier = F.array_position(F.array(*[F.lit(a) for a in AREAS]), F.col("area"))
    weight = F.when(F.col("impact") == "high", 3).when(F.col("impact") == "medium", 2).otherwise(1)
    order = Window.partitionBy(by).orderBy(F.desc(weight), tier, "ord", "finding")
    return rows.withColumn("rank", F.row_number().over(order)).drop("ord")


def page_findings(pages: DataFrame, checks: DataFrame, by: str = "page_id") -> DataFrame:
    """by, finding, impact, effort, area of what doesn't follow from one failed check.

    ``pages`` has one row for each: status, raw_words and rendered_words (null without a render), sitemap_ok (null where
    none was asked for) and risk (high, review or clean).
    """
    named = ("diff.spa_shell", "diff.content", "eeat.contact_info")
    failed = checks.where((F.col("status") == "fail") & F.col("check_id").isin(*named)).groupBy(by).agg(*[F.bool_or(F.col("check_id") == c).alias(c.replace(".", "_")) for c in named])
    rows = pages.join(failed, by, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    raw, rendered = F.coalesce("raw_words", F.lit(0)), F.coalesce("rendered_words", F.lit(0))
    gap = rendered - raw
    shell = is_("diff_spa_shell") | ((raw < 150) & (rendered >= raw * 3) & (gap >= 200))
    impacts = [
        ("http.error", "small", "access", F.when((F.coalesce("status", F.lit(0)) == 0) | (F.col("status") >= 400), "high")),
        ("render.js_only", "large", "render", F.when(shell, "high").when(is_("diff_content") & (gap >= 200), "medium")),
        ("sitemap.missing", "small", "meta", F.when(~F.col("sitemap_ok"), "medium")), ("content.contact", "small", "content", F.when(is_("eeat_contact_info"), "medium")),
        ("risk.flags", "small", "other", F.when(F.col("risk") == "high", "high").when(F.col("risk") == "review", "medium")),
    ]
    found = [F.when(i.isNotNull(), F.struct(F.lit(f).alias("finding"), i.alias("impact"), F.lit(e).alias("effort"), F.lit(a).alias("area"))) for f, e, a, i in impacts]
    return rows.select(by, F.explode(F.array_compact(F.array(*found))).alias("f")).select(by, "f.*")


def strengths(pages: DataFrame, by: str = "page_id") -> DataFrame:
    """by, ord, strength of what works: pages has robots_open, rendered (a render took place), raw_words, js_only, blocks, llms and sitemap_locs."""
    found = [
        F.when(F.col("robots_open"), "AI search crawlers are allowed"),
        F.when(F.col("rendered") & ~F.col("js_only") & (F.col("raw_words") >= 80), "the content is readable without JavaScript"),
        F.when(F.col("blocks") > 0, "structured data is present"), F.when(F.col("llms"), "llms.txt is published"),
        F.when(F.col("sitemap_locs") >= 0, F.concat(F.lit("sitemap.xml lists "), F.col("sitemap_locs").cast("string"), F.when(F.col("sitemap_locs") == 1, " URL").otherwise(" URLs"))),
    ]
    return pages.select(by, F.posexplode(F.array_compact(F.array(*found))).alias("ord", "strength"))


def top_and_rest(found: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """The first findings of each page, and the appendix."""
    return found.where(F.col("rank") <= top), found.where(F.col("rank") > top)


def summaries(pages: DataFrame, found: DataFrame, strong: DataFrame, by: str = "page_id") -> DataFrame:
    """by, headline, summary: what to fix first, and up to three things that work."""
    high = F.col("impact") == "high"
    counts = found.groupBy(by).agg(F.count("*").alias("all"), F.count_if(high).alias("high"), F.min_by("finding", F.when(high, F.col("rank"))).alias("first"))
    works = strong.where("ord < 3").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "strength"))), lambda x: x["strength"]), ", ").alias("works"))
    rows = pages.select(by).join(counts, by, "left").join(works, by, "left")
    some = F.when(F.col("high") == 1, "One problem").otherwise(F.concat(F.col("high").cast("string"), F.lit(" problems")))
    headline = (
        F.when(F.coalesce("all", F.lit(0)) == 0, "Nothing on this page needs fixing.")
        .when(F.col("high") == 0, F.concat(F.lit("Nothing is blocking search engines or AI crawlers. The "), F.least("all", F.lit(5)).cast("string"), F.lit(" fixes below are improvements, most important first.")))
        .otherwise(F.concat(some, F.lit(" to fix first, starting with: "), F.col("first"), F.lit(".")))
    )
    good = F.when(F.col("works").isNotNull(), F.concat(F.lit("What's working: "), F.col("works"), F.lit(".")))
    return rows.select(by, headline.alias("headline"), F.concat_ws(" ", good, headline).alias("summary"))


def with_files(found: DataFrame, files: DataFrame, by: str = "page_id") -> DataFrame:
    """Findings with the generated file that fixes them, null where there is none. ``files`` has by and file."""
    kinds = {"robots": ("robots.blocks_all", "robots.blocks_ai_search", "robots.named_group_gap", "robots.missing"), "schema_org": ("schema.missing", "schema.no_org"), "schema_fixed": ("schema.vocabulary",), "llms": ("llms.steering", "llms.format", "llms.missing")}
    table = F.create_map(*[F.lit(x) for file, names in kinds.items() for n in names for x in (n, file)])
    there = files.select(by, F.col("file").alias("fix_file")).distinct()
    return found.withColumn("fix_file", table[F.col("finding")]).join(there.withColumn("__there", F.lit(True)), [by, "fix_file"], "left").withColumn("fix_file", F.when(F.col("__there"), F.col("fix_file"))).drop("__there")


def impact_counts(found: DataFrame, by: str = "page_id") -> DataFrame:
    return found.groupBy(by).agg(*[F.count_if(F.col("impact") == i).alias(i) for i in IMPACT_RANK])


def fix_snippets(checks: DataFrame, by: str = "page_id") -> DataFrame:
    """by, snippet: one row for each snippet that any failed check asks for."""
    table = checks.sparkSession.createDataFrame([(s, c) for s, cs in SNIPPETS.items() for c in cs], "snippet string, check_id string")
    return checks.where("status = 'fail'").join(F.broadcast(table), "check_id").select(by, "snippet").distinct()


def fix_texts(snippets: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, snippet, target, text: what to paste where. ``pages`` has page_id, url, title and description."""
    title, about = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("title", "description")]
    named, told = F.coalesce(truncated(title, 60), F.lit("")), F.coalesce(truncated(about, 120), F.lit(""))
    named, told = F.when(title.isNull(), "Page Title").otherwise(named), F.when(about.isNull(), "Description").otherwise(told)
    url, base = F.col("url"), F.regexp_replace("url", "/$", "")
    tag = lambda kind, key, value: F.concat(F.lit(f'<meta {kind}="{key}" content="'), value if isinstance(value, Column) else F.lit(value), F.lit('">'))
    lines = lambda *parts: F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    page = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("WebPage").alias("@type"), F.coalesce(title, F.lit("Page Title")).alias("name"), url.alias("url"),
        F.coalesce(about, F.lit("Page description.")).alias("description"),
    )
    texts = {
        "title": ("<head>", lines("<title>Primary Keyword — Brand Name</title>")),
        "description": ("<head>", lines(tag("name", "description", "A summary of the page in 140 to 160 characters that says what it offers."))),
        "canonical": ("<head>", F.concat(F.lit('<link rel="canonical" href="'), url, F.lit('">'))),
        "open_graph": ("<head>", lines(
            tag("property", "og:title", named), tag("property", "og:description", told), tag("property", "og:image", F.concat(base, F.lit("/og-image-1200x630.jpg"))),
            tag("property", "og:image:width", "1200"), tag("property", "og:image:height", "630"), tag("property", "og:url", url), tag("property", "og:type", "website"))),
        "twitter": ("<head>", lines(tag("name", "twitter:card", "summary_large_image"), tag("name", "twitter:title", named), tag("name", "twitter:description", told))),
        "llms": ("/llms.txt", lines(
            F.concat(F.lit("# "), F.when(title.isNull(), "Your Site Name").otherwise(truncated(title, 60))), "",
            F.concat(F.lit("> "), F.when(about.isNull(), "What the site offers, in one or two sentences.").otherwise(truncated(about, 140))), "",
            "## Key Pages", F.concat(F.lit("- [Home]("), url, F.lit("): Landing page")), "- [About](/about): About the organisation")),
        "favicon": ("<head>", lines('<link rel="icon" href="/favicon.ico" sizes="any">', '<link rel="apple-touch-icon" href="/apple-touch-icon.png">')),
        "schema": ("<head> or <body>", lines('<script type="application/ld+json">', F.to_json(page), "</script>")),
        "lcp": ("<head> and hero <img>", lines(
            '<link rel="preload" as="image" href="/hero.webp" fetchpriority="high">', '<img src="/hero.webp" width="1200" height="630" alt="Hero" fetchpriority="high" decoding="async">')),
        "scripts": ("<head>", lines('<script src="/app.js" defer></script>')),
        "iframes": ("<iframe>", lines('<iframe src="/embed" width="560" height="315" loading="lazy" title="Embedded content"></iframe>')),
        "trust": ("footer", lines(
            "<footer>", '  <nav aria-label="Legal">', '    <a href="/about">About</a>', '    <a href="/contact">Contact</a>', '    <a href="/privacy-policy">Privacy Policy</a>',
            '    <a href="/terms">Terms</a>', "  </nav>", "</footer>")),
    }
    made = F.coalesce(*[F.when(F.col("snippet") == k, F.struct(F.lit(t).alias("target"), x.alias("text"))) for k, (t, x) in texts.items()])
    return snippets.join(pages.select("page_id", "url", "title", "description"), "page_id").select("page_id", "snippet", made.alias("m")).select("page_id", "snippet", "m.*")
