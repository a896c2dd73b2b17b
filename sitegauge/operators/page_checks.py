"""Rule checks of pages as column expressions over extracted facts: one row per page and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.operators.extraction import word_count

#: Fixed values, down to SCHEMA_REQUIRED: modules with weights, severities with weights and ranks, patterns of
#: anchors and of paths that build trust, and types of structured data with the fields that they need.
MODULES = (
    ("meta_and_social", 12), ("geo_ai_validator", 12), ("js_render_diff", 14), ("dom_headings", 8), ("link_navigation", 10),
    ("schema_rich", 10), ("eeat_trust", 10), ("server_security", 10), ("performance_cwv", 12),
)
SEVERITY_WEIGHT = {"critical": 6, "warning": 3, "notice": 1, "info": 1}
SEVERITY_RANK = {"critical": 3, "warning": 2, "notice": 1, "info": 0}
GENERIC_ANCHOR = r"(?i)^(click here|here|read more|learn more|more|this|link|website|http\S*)$"
TRUST_PATHS = {
    "about": r"(?i)/(about|about-us|company|team)(/|$|\?)",
    "contact": r"(?i)/(contact|contact-us|support|help)(/|$|\?)",
    "privacy": r"(?i)/(privacy|privacy-policy|legal)(/|$|\?)",
    "terms": r"(?i)/(terms|terms-of-service|tos|tos-of-service|legal/terms)(/|$|\?)",
}
SCHEMA_PRIMARY = ("Article", "NewsArticle", "BlogPosting", "Product", "Organization", "LocalBusiness", "WebSite", "WebPage", "FAQPage", "BreadcrumbList")
SCHEMA_REQUIRED = {
    "Article": ("headline", "author", "datePublished"), "NewsArticle": ("headline", "author", "datePublished"), "BlogPosting": ("headline", "author", "datePublished"),
    "Product": ("name", "offers"), "Organization": ("name", "url"), "LocalBusiness": ("name", "address", "telephone"), "FAQPage": ("mainEntity",),
    "BreadcrumbList": ("itemListElement",), "WebSite": ("name", "url"), "WebPage": ("name", "url"), "Person": ("name",), "Event": ("name", "startDate", "location"),
}
C, W, N = "critical", "warning", "notice"


def meta(name: str) -> Column:
    """A meta value; an empty one counts as missing."""
    return F.nullif(F.element_at("metas", name), F.lit(""))


def tag(name: str) -> Column:
    return F.coalesce(F.element_at("tags", name), F.lit(0))


def many(column: str, test) -> Column:
    return F.size(F.filter(column, test))


def field_like(field: str, pattern: str):
    """A test of array elements: whether a field, null as empty, matches."""
    return lambda x: F.coalesce(x[field], F.lit("")).rlike(pattern)


def first_of(*rules: tuple[Column, str | None]) -> Column:
    """Severity of the first rule that holds: a severity fails, ``skip`` skips, None and no rule at all pass."""
    out = F
    for test, severity in rules:
        out = out.when(test, F.lit(severity or "pass"))
    return F.coalesce(out.otherwise(F.lit("pass")), F.lit("pass"))


def check(module: str, name: str, *rules: tuple[Column, str | None], value: Column | None = None) -> Column:
    outcome = first_of(*rules) if rules else F.lit("pass")
    failed = outcome.isin(C, W, N)
    return F.struct(
        F.lit(module).alias("module"),
        F.lit(name).alias("check_id"),
        F.when(failed, "fail").otherwise(outcome).alias("status"),
        F.when(failed, outcome).otherwise("info").alias("severity"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
    )


def metadata_checks() -> list[Column]:
    m = "meta_and_social"
    length, px = F.char_length("title"), F.floor(F.char_length("title") * 8.5 + 0.5)
    described = F.coalesce(F.trim(meta("description")), F.lit(""))
    h1 = F.col("__h1")
    levels = F.transform("headings", lambda h: h["level"])
    jumps = F.exists(F.transform(levels, lambda x, i: x - F.get(levels, i - 1)), lambda step: step > 1)  # before the first: null
    origin = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    og = F.array(*[meta(f"og:{k}").isNull() for k in ("title", "description", "image", "url", "type")])
    width, height = [F.expr(f"try_cast(regexp_extract(metas['og:image:{k}'], '^\\\\s*(-?[0-9]+)', 1) AS int)") for k in ("width", "height")]
    images = F.size("images")
    no_alt, empty_alt = many("images", lambda i: i["alt"].isNull()), many("images", lambda i: i["alt"] == "")
    return [
        check(m, "title.present", (F.col("title") == "", C), value=length),
        check(m, "title.length", (F.col("title") == "", "absent"), (length < 15, C), (length < 50, W), ((length <= 60) & (px <= 580), None), ((length <= 70) & (px <= 600), W), (F.lit(True), C), value=length),
        check(m, "meta_description.present", (described == "", C)),
        check(m, "meta_description.length", (described == "", "absent"), (F.char_length(described) < 70, W), (F.char_length(described) < 140, N), (F.char_length(described) > 160, W), value=F.char_length(described)),
        check(m, "h1.present", (h1 == 0, C), (h1 > 1, W), value=h1),
        check(m, "headings.hierarchy", (F.size("headings") == 0, W), (jumps, N)),
        check(m, "canonical.present", (F.col("canonical").isNull(), W), (origin("canonical") != origin("url"), C)),
        check(m, "robots.noindex", (F.coalesce(meta("robots"), F.lit("")).rlike("(?i)noindex|none"), C)),
        check(m, "og.complete", (F.exists(og, lambda x: x), W)),
        check(m, "og.image_dims", (meta("og:image").isNull(), "skip"), (width.isNull() | height.isNull(), N), ((width < 1200) | (height < 630), N)),
        check(m, "twitter.card", (meta("twitter:card").isNull(), N)),
        check(m, "viewport.present", (meta("viewport").isNull(), W)),
        check(m, "html.lang", (F.col("lang").isNull(), N), value=F.col("lang")),
        check(m, "favicon.present", (~F.col("has_favicon"), N)),
        check(m, "charset.present", (F.col("charset").isNull(), N), value=F.col("charset")),
        check(m, "images.alt", (images == 0, "skip"), (no_alt > 0, W), (empty_alt > images * 0.5, N)),
    ]


def dom_checks() -> list[Column]:
    m = "dom_headings"
    h1 = F.col("__h1")
    words = F.col("__words")
    ratio = F.coalesce(F.floor(100 * F.char_length("text") / F.nullif(F.char_length("html"), F.lit(0)) + 0.5), F.lit(0))
    present = lambda *names: sum((tag(n) > 0).cast("int") for n in names)
    return [
        check(m, "dom.node_count", (F.col("node_count") > 3000, C), (F.col("node_count") > 1500, W), value=F.col("node_count")),
        check(m, "dom.depth", (F.col("max_depth") > 32, W), value=F.col("max_depth")),
        check(m, "dom.landmarks", (present("main", "nav", "header", "footer") < 3, W)),
        check(m, "dom.main", (tag("main") != 1, W)),
        check(m, "dom.semantic_rich", (present("article", "section", "figure", "time") < 2, N)),
        check(m, "dom.duplicate_ids", (F.size("duplicate_ids") > 0, W), value=F.size("duplicate_ids")),
        check(m, "headings.h1", (h1 == 0, C), (h1 > 1, W), value=h1),
        check(m, "dom.text_html_ratio", (ratio < 5, W), (ratio < 10, N), value=ratio),
        check(m, "dom.word_count", (words < 200, W), (words < 300, N), value=words),
        check(m, "dom.iframe_dims", (F.size("iframes") == 0, "skip"), (F.exists("iframes", lambda i: ~i["has_dims"]), W)),
    ]


def link_checks() -> list[Column]:
    m = "link_navigation"
    internal = many("links", lambda x: x["internal"] & ~x["is_anchor"])
    anchors, relative = many("links", lambda x: x["is_anchor"]), many("links", lambda x: x["protocol_relative"])
    naked = many("links", lambda x: x["text"].rlike(r"(?i)^https?://"))
    generic = many("links", lambda x: x["text"].rlike(GENERIC_ANCHOR))
    return [
        check(m, "links.inventory", value=F.concat_ws(",", internal, F.size("links") - internal - anchors, anchors, relative)),
        check(m, "links.internal", (internal < 3, W), (internal < 5, N), value=internal),
        check(m, "links.anchor_text", (generic > 0, W), value=generic),
        check(m, "links.naked_urls", ((naked > F.size("links") * 0.5) & (F.size("links") > 5), N), value=naked),
        check(m, "links.noopener", (F.exists("links", lambda x: (x["target"] == "_blank") & ~x["rel"].contains("noopener")), W)),
        check(m, "links.rel", value=many("links", lambda x: x["rel"].rlike("nofollow|sponsored|ugc"))),
        check(m, "links.hreflang", (F.size("hreflang") == 0, "skip")),
    ]


def schema_types() -> Column:
    """Distinct types of all nodes, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform("nodes", lambda n: n["types"]))))


def missing_fields() -> Column:
    """type.field of what the nodes lack: each type meets its required fields in a literal map, a join without rows."""
    needed = F.create_map(*[x for t, fields in SCHEMA_REQUIRED.items() for x in (F.lit(t), F.array(*map(F.lit, fields)))])
    lacks = lambda n, t: F.transform(F.array_except(F.coalesce(needed[t], F.array().cast("array<string>")), n["filled"]), lambda f: F.concat(t, F.lit("."), f))
    return F.flatten(F.transform("nodes", lambda n: F.flatten(F.transform(n["types"], lambda t: lacks(n, t)))))


def unseen_entities() -> Column:
    """Kinds of headlines, product names and questions of which the first letters don't stand in the page's text."""
    text = F.lower("text")
    unseen = lambda value, n: (F.coalesce(value, F.lit("")) != "") & ~F.contains(text, F.substring(F.lower(value), 1, n))

    def kinds(n: Column) -> Column:
        article = F.arrays_overlap(n["types"], F.array(*map(F.lit, ("Article", "NewsArticle", "BlogPosting")))) & unseen(n["headline"], 30)
        product = F.array_contains(n["types"], "Product") & unseen(n["name"], 20)
        faq = F.array_contains(n["types"], "FAQPage") & F.exists(n["questions"], lambda q: unseen(q, 20))
        return F.array_compact(F.array(F.when(article, "headline"), F.when(product, "name"), F.when(faq, "questions")))

    return F.flatten(F.transform("nodes", kinds))


def schema_checks() -> list[Column]:
    m = "schema_rich"
    broken, types = F.col("json_ld_broken"), schema_types()
    none = F.size("json_ld") - broken == 0
    found = lambda name: F.array_contains(types, name)
    faq = F.col("text").rlike(r"(?i)\b(faq|frequently asked questions|q&a)\b")
    missing, unseen = missing_fields(), unseen_entities()
    return [
        check(m, "schema.syntax", (F.size("json_ld") == 0, "skip"), (broken > 0, C), value=broken),
        check(m, "schema.present", (none, W)),
        check(m, "schema.types", (none, "absent"), value=F.array_join(types, ",")),
        check(m, "schema.primary_entity", (none, "absent"), (~F.arrays_overlap(types, F.array(*map(F.lit, SCHEMA_PRIMARY))), W)),
        check(m, "schema.required_fields", (none, "absent"), (F.size(missing) > 0, W), value=F.array_join(missing, ",")),
        check(m, "schema.entity_match", (none, "absent"), (F.size(unseen) > 0, W), value=F.array_join(unseen, ",")),
        check(m, "schema.breadcrumb", (none, "absent"), (~found("BreadcrumbList"), N)),
        check(m, "schema.faq", (none, "absent"), (found("FAQPage"), None), (~faq, "skip"), (F.lit(True), N)),
    ]


def trust_checks() -> list[Column]:
    m = "eeat_trust"
    words = F.col("__words")
    by_meta = (meta("author").isNotNull() | meta("article:author").isNotNull()).cast("int")
    by_schema = F.exists("nodes", lambda n: F.array_contains(n["filled"], "author") | F.array_contains(n["types"], "Person")).cast("int")
    by_text = F.substring("text", 1, 2000).rlike(r"(?i)\b(by|author|written by|reviewed by)\b").cast("int")
    signals = by_meta + by_schema + by_text
    trust = sum(F.exists("links", field_like("resolved", p)).cast("int") for p in TRUST_PATHS.values())
    dated = lambda *names: F.expr(f"try_to_timestamp(coalesce({', '.join(f'''nullif(metas['{n}'], '')''' for n in names)}))")
    return [
        check(m, "eeat.author", (signals == 0, W), (signals == 1, N), value=signals),
        check(m, "eeat.published_time", (dated("article:published_time", "datePublished").isNull(), N)),
        check(m, "eeat.modified_time", (dated("article:modified_time", "dateModified").isNull(), N)),
        check(m, "eeat.trust_links", (trust == 0, C), (trust < 3, W), value=trust),
        check(m, "eeat.https", (~F.col("url").rlike("(?i)^https:"), C)),
        check(m, "eeat.thin_content", (words < 200, W), (words < 300, N), value=words),
        check(m, "eeat.contact_info", (~F.col("text").rlike(r"(?i)\b(\+?\d[\d\s().-]{7,}|@[a-z0-9.-]+\.[a-z]{2,})\b"), "skip")),
    ]


def performance_checks() -> list[Column]:
    m = "performance_cwv"
    images = F.size("images")
    likely = F.coalesce(
        F.get(F.filter("images", lambda i: i["priority"] == "high"), F.lit(0)),
        F.get(F.filter("images", lambda i: ~F.coalesce(i["src"], F.lit("")).rlike("(?i)logo|icon|sprite|pixel")), F.lit(0)),
    )
    h1 = F.col("__h1")
    unsized = many("images", lambda i: ~((i["width"].isNotNull() & i["height"].isNotNull()) | i["style_dims"] | i["in_picture"]))
    legacy, modern = [many("images", field_like("src", p)) for p in (r"(?i)\.(jpe?g|png|gif)(\?|$)", r"(?i)\.(webp|avif)(\?|$)")]
    responsive = F.exists("images", lambda i: i["srcset"].isNotNull() | i["in_picture"])
    inline = F.aggregate("scripts", F.lit(0).cast("long"), lambda n, s: n + s["inline_bytes"]) + F.col("inline_style_bytes")
    return [
        check(m, "cwv.lcp_candidate", (likely.isNull() & (h1 == 0), N)),
        check(m, "cwv.lcp_fetchpriority", (likely.isNull(), "skip"), (likely["priority"] != "high", W)),
        check(m, "cwv.lcp_lazy", (likely.isNull(), "skip"), (likely["loading"] == "lazy", C)),
        check(m, "cwv.image_dims", (images == 0, "skip"), (unsized > 0, W), value=unsized),
        check(m, "cwv.iframe_dims", (F.size("iframes") == 0, "skip"), (F.exists("iframes", lambda i: ~i["has_dims"]), W)),
        check(m, "cwv.blocking_scripts", (F.exists("scripts", lambda s: s["blocking"]), C)),
        check(m, "cwv.blocking_css", (many("stylesheets", lambda s: s["blocking"]) > 3, W)),
        check(m, "cwv.image_formats", (images == 0, "skip"), ((legacy > 0) & (modern == 0) & ~responsive, N)),
        check(m, "cwv.inline_payload", (inline > 100 * 1024, N), value=inline),
    ]


def checks_of(facts: DataFrame, rows: list[Column], by: str = "page_id") -> DataFrame:
    """One row for each check that applies; an absent one gives no row. No shuffle takes place."""
    exploded = facts.select(by, F.explode(F.array(*rows)).alias("c"))
    return exploded.select(by, "c.*").where("status <> 'absent'")


def page_checks(facts: DataFrame) -> DataFrame:
    """page_id, module, check_id, status, severity, value of every check of a page's own HTML.

    What several rules share is computed in a projection before theirs.
    """
    facts = facts.withColumns({"__words": word_count("text"), "__h1": many("headings", lambda h: h["level"] == 1)})
    rows = [*metadata_checks(), *dom_checks(), *link_checks(), *schema_checks(), *trust_checks(), *performance_checks()]
    return checks_of(facts, rows)


def head_checks(pages: DataFrame, heads: DataFrame, most: int = 15) -> DataFrame:
    """Checks of what a page points to, by the answers of HEAD requests: social.image_reachable, links.broken_external.

    ``pages`` has page_id, social_image and links of the facts; ``heads`` has url and status. The first ``most``
    external links of a page are looked at (that many are asked for). Without an answer for any of them the check is skipped;
    an image without one fails. Urls meet their answers in one shuffled join on the url.
    """
    external = F.filter("links", lambda x: ~x["internal"] & ~x["is_anchor"] & x["resolved"].isNotNull())
    links = pages.select("page_id", F.explode_outer(F.slice(F.transform(external, lambda x: x["resolved"]), 1, most)).alias("url"), F.lit("link").alias("kind"))
    images = pages.select("page_id", F.col("social_image").alias("url"), F.lit("image").alias("kind"))
    asked = links.unionByName(images).join(heads.select("url", "status").dropDuplicates(["url"]), "url", "left")
    link, bad = F.col("kind") == "link", F.coalesce("status", F.lit(0)).between(1, 399)
    found = asked.groupBy("page_id").agg(
        F.count_if(link & F.col("url").isNotNull() & F.col("status").isNotNull()).alias("tried"), F.count_if(link & F.col("status").isNotNull() & ~bad).alias("broken"),
        F.max(F.when(~link, F.col("url"))).alias("image"), F.max(F.when(~link, F.coalesce("status", F.lit(0)))).alias("image_status"),
    )
    return checks_of(found, [
        check("meta_and_social", "social.image_reachable", (F.coalesce("image", F.lit("")) == "", "skip"), (F.col("image_status") != 200, W), value=F.col("image_status")),
        check("link_navigation", "links.broken_external", (F.col("tried") == 0, "skip"), (F.col("broken") > 0, W), value=F.col("broken")),
    ])


def resource_checks(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """cwv.third_party_scripts and cwv.oversize_assets: ``resources`` has page_id, name, kind and bytes of what a render loaded.

    Pages without a render have no third-party scripts and skip the sizes. ``pages`` has page_id and url.
    """
    site = lambda c: F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    own = pages.select("page_id", site("url").alias("site"))
    seen = own.join(resources.select("page_id", "name", "kind", "bytes"), "page_id", "left").groupBy("page_id").agg(
        F.count("name").alias("loaded"), F.count_if((F.col("kind") == "script") & (site("name") != F.col("site"))).alias("foreign"),
        F.count_if(F.col("bytes") > 200 * 1024).alias("large"),
    )
    return checks_of(seen, [
        check("performance_cwv", "cwv.third_party_scripts", (F.col("foreign") > 5, W), value=F.col("foreign")),
        check("performance_cwv", "cwv.oversize_assets", (F.col("loaded") == 0, "skip"), (F.col("large") > 0, W), value=F.col("large")),
    ])
