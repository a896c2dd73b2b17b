"""What robots.txt files do to crawlers: reports, findings, repaired files, and access reports of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.operators.robots import robots_lines
from sitegauge.operators.site_checks import is_text_file

#: Crawlers that answer questions and that gather training data, and other crawlers by their usual spelling.
AI_SEARCH = ("OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Perplexity-User", "Claude-SearchBot", "Claude-User")
AI_TRAINING = ("GPTBot", "ClaudeBot", "Google-Extended", "Applebot-Extended", "CCBot", "anthropic-ai", "Bytespider", "cohere-ai")
OTHER_BOTS = ("Claude-Web", "Googlebot", "Bingbot", "Applebot", "DuckDuckBot", "YandexBot", "Baiduspider")
#: Crawlers of the access report, with their operator and purpose.
ACCESS = (
    ("OAI-SearchBot", "OpenAI", "search"), ("ChatGPT-User", "OpenAI", "search"), ("Claude-SearchBot", "Anthropic", "search"), ("Claude-User", "Anthropic", "search"),
    ("PerplexityBot", "Perplexity", "search"), ("Bingbot", "Microsoft (Bing, Copilot)", "search"), ("Googlebot", "Google", "search"), ("GPTBot", "OpenAI", "training"),
    ("ClaudeBot", "Anthropic", "training"), ("Google-Extended", "Google (Gemini)", "training"), ("Applebot-Extended", "Apple", "training"), ("CCBot", "Common Crawl", "training"),
)
#: Impact, effort and area of findings about robots.txt, in their order.
ROBOTS_FINDINGS = {
    "robots.blocks_all": ("high", "small", "access"), "robots.blocks_ai_search": ("high", "small", "access"), "robots.named_group_gap": ("medium", "small", "access"),
    "robots.missing": ("low", "small", "access"), "robots.blocks_ai_training": ("low", "small", "access"),
}
GROUPS = "array<struct<group_no:bigint,agents:array<string>,rules:array<struct<type:string,path:string>>>>"


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def rule(type_: str, path) -> Column:
    return F.struct(F.lit(type_).alias("type"), (F.lit(path) if isinstance(path, str) else path).alias("path"))


def robots_groups(files: DataFrame, text: str = "text") -> DataFrame:
    """site, groups: the groups of each file in order, with agents (lower case) and rules in order. One row per site with a group."""
    order = Window.partitionBy("site").orderBy("line_no")
    lines = robots_lines(files, text).where("key in ('user-agent', 'allow', 'disallow')")
    agent = F.col("key") == "user-agent"
    opens = agent & (F.coalesce(F.lag("key").over(order), F.lit("disallow")) != "user-agent")
    lines = lines.withColumn("group_no", F.sum(opens.cast("int")).over(order))
    of = lambda test, *fields: F.array_sort(F.collect_list(F.when(test, F.struct("line_no", *fields))))
    by_group = lines.groupBy("site", "group_no").agg(of(agent, F.lower("value").alias("agent")).alias("a"), of(~agent, F.col("key").alias("type"), F.col("value").alias("path")).alias("r"))
    named = F.array_distinct(F.transform("a", lambda x: x["agent"]))
    rules = F.transform("r", lambda x: F.struct(x["type"].alias("type"), x["path"].alias("path")))
    groups = by_group.select("site", F.struct("group_no", F.when(F.size("a") == 0, literals(("*",))).otherwise(named).alias("agents"), rules.alias("rules")).alias("g"))
    return groups.groupBy("site").agg(F.array_sort(F.collect_list("g")).alias("groups"))


def blocks_root(rules: Column) -> Column:
    root = lambda type_: F.exists(rules, lambda r: (r["type"] == type_) & r["path"].isin("/", "/*"))
    return root("disallow") & ~root("allow")


def star_groups() -> Column:
    return F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))


def rules_of(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: g["rules"]))


def disallowed(rules: Column) -> Column:
    return F.transform(F.filter(rules, lambda r: r["type"] == "disallow"), lambda r: r["path"])


def blocked_bots(bots) -> Column:
    """The bots that the root is closed to: by the groups that name them, else by those of ``*``."""

    def blocked(bot: Column) -> Column:
        own = F.filter("groups", lambda g: F.array_contains(g["agents"], F.lower(bot)))
        return blocks_root(rules_of(F.when(F.size(own) > 0, own).otherwise(star_groups())))

    return F.filter(literals(bots), blocked)


def robots_report(files: DataFrame) -> DataFrame:
    """One row per site of ``files`` (site, status, content_type, text): what its robots.txt does.

    missing (404, 410 or no answer), valid (a text file), blocks_all, blocked_search, blocked_training, star_disallows (paths of
    ``*`` but the root), gaps (named groups that lack some of these, as they ignore ``*``), sitemaps, and the groups.
    """
    valid = is_text_file(F.col("status"), F.col("content_type"), F.col("text"))
    own = files.select("site", "status", "text", valid.alias("valid"), (F.col("status").isNull() | F.col("status").isin(404, 410)).alias("missing"))
    maps = robots_lines(own.where("valid")).where("key = 'sitemap'").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("m"))
    joined = own.join(robots_groups(own.where("valid")), "site", "left").join(maps, "site", "left")
    joined = joined.withColumns({
        "groups": F.coalesce("groups", F.array().cast(GROUPS)),
        "sitemaps": F.coalesce(F.transform("m", lambda x: x["value"]), F.array().cast("array<string>")),
    })
    star = F.filter(disallowed(rules_of(star_groups())), lambda p: ~p.isin("", "/", "/*"))
    gap = lambda g: F.struct(g["agents"].alias("agents"), F.array_except("star_disallows", disallowed(g["rules"])).alias("missing"))
    named = F.filter("groups", lambda g: ~F.array_contains(g["agents"], "*") & ~blocks_root(g["rules"]))
    seen = joined.withColumn("star_disallows", star)
    return seen.select(
        "site", "status", "valid", "missing", (F.size(star_groups()) > 0).__and__(blocks_root(rules_of(star_groups()))).alias("blocks_all"),
        blocked_bots(AI_SEARCH).alias("blocked_search"), blocked_bots(AI_TRAINING).alias("blocked_training"), "star_disallows",
        F.filter(F.transform(named, gap), lambda g: F.size(g["missing"]) > 0).alias("gaps"), "sitemaps", "groups",
    )


def robots_findings(report: DataFrame) -> DataFrame:
    """site, finding, impact, effort, area, ord."""
    search, training = F.size("blocked_search") > 0, F.size("blocked_training") > 0
    tests = (F.col("blocks_all"), ~F.col("blocks_all") & search, F.size("gaps") > 0, F.col("missing"), training & ~search)
    rows = [F.when(t, F.struct(F.lit(f).alias("finding"), *[F.lit(v).alias(k) for k, v in zip(("impact", "effort", "area"), i)], F.lit(n).alias("ord"))) for n, (t, (f, i)) in enumerate(zip(tests, ROBOTS_FINDINGS.items()))]
    return report.select("site", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("site", "f.*")


def robots_file(report: DataFrame) -> DataFrame:
    """site, content: each file repaired.

    ``*`` lets everyone in; search crawlers leave groups that shut them out; named groups repeat what ``*``
    disallows; groups of equal rules are one; names have their usual spelling. Training crawlers keep what the owner chose.
    """
    g_type = "array<struct<agents:array<string>,rules:array<struct<type:string,path:string>>,star:boolean>>"
    group = lambda agents, rules, star=False: F.struct(agents.alias("agents"), rules.alias("rules"), F.lit(star).alias("star"))
    let_in = F.array(rule("allow", "/"))
    search = literals([b.lower() for b in AI_SEARCH])
    first_star = F.get(F.transform(star_groups(), lambda g: g["group_no"]), F.lit(0))
    own = report.withColumn("first_star", first_star)
    opened = lambda rules: F.filter(rules, lambda r: ~((r["type"] == "disallow") & r["path"].isin("/", "/*")))
    allows = lambda rules: F.exists(rules, lambda r: (r["type"] == "allow") & (r["path"] == "/"))
    star_rules = lambda rules: F.when(~F.col("blocks_all"), rules).when(allows(rules), opened(rules)).otherwise(F.concat(let_in, opened(rules)))

    def parts(g: Column) -> Column:
        freed, rest = F.array_intersect(g["agents"], search), F.array_except(g["agents"], search)
        both = F.array_compact(F.array(F.when(F.size(rest) > 0, group(rest, g["rules"])), group(freed, let_in)))
        return (
            F.when(g["group_no"] == F.col("first_star"), F.array(group(g["agents"], star_rules(g["rules"]), True)))
            .when(blocks_root(g["rules"]) & (F.size(freed) > 0), both)
            .otherwise(F.array(group(g["agents"], g["rules"])))
        )

    cut = F.flatten(F.transform("groups", parts))
    own = own.withColumn("cut", F.when(F.col("first_star").isNull(), F.concat(F.array(group(literals(("*",)), let_in, True)), cut)).otherwise(cut).cast(g_type))
    own = own.withColumn("star_now", F.filter(disallowed(rules_of(F.filter("cut", lambda g: g["star"]))), lambda p: p.isNotNull()))
    repeated = lambda g: F.concat(g["rules"], F.transform(F.array_except("star_now", disallowed(g["rules"])), lambda p: rule("disallow", p)))
    whole = F.transform("cut", lambda g: F.struct(g["agents"].alias("agents"), F.when(g["star"] | blocks_root(g["rules"]), g["rules"]).otherwise(repeated(g)).alias("rules"), g["star"].alias("star")))
    own = own.withColumn("whole", whole)
    same = lambda g: F.filter("whole", lambda h: ~h["star"] & (h["rules"] == g["rules"]))
    place = lambda g: F.array_position(F.transform("whole", lambda h: ~h["star"] & (h["rules"] == g["rules"])), True)
    kept = F.filter("whole", lambda g, i: g["star"] | (place(g) == i + 1))
    merged = F.transform(kept, lambda g: F.struct(F.when(g["star"], g["agents"]).otherwise(F.array_distinct(F.flatten(F.transform(same(g), lambda h: h["agents"])))).alias("agents"), g["rules"].alias("rules")))
    spelled = F.create_map(*[x for b in (*AI_SEARCH, *AI_TRAINING, *OTHER_BOTS) for x in (F.lit(b.lower()), F.lit(b))])
    lines = lambda g: F.concat(
        F.transform(g["agents"], lambda a: F.concat(F.lit("User-agent: "), F.coalesce(spelled[a], a))),
        F.transform(g["rules"], lambda r: F.concat(F.initcap(r["type"]), F.lit(": "), r["path"])), literals(("",)),
    )
    head = literals(("# Check this file before you upload it:", "# comments of the file it replaces are not carried over.", ""))
    content = F.array_join(F.concat(head, F.flatten(F.transform(merged, lines)), F.transform("sitemaps", lambda s: F.concat(F.lit("Sitemap: "), s))), "\n")
    return own.select("site", F.concat(F.rtrim(F.regexp_replace(content, r"\n+$", "")), F.lit("\n")).alias("content"))


def access_table(report: DataFrame) -> DataFrame:
    """site, bot, operator, purpose, blocked for the crawlers of the access report."""
    bots = F.array(*[F.struct(F.lit(b).alias("bot"), F.lit(o).alias("operator"), F.lit(p).alias("purpose")) for b, o, p in ACCESS])
    rows = report.select("site", blocked_bots([b for b, *_ in ACCESS]).alias("closed"), F.explode(bots).alias("b"))
    return rows.select("site", "b.*", F.array_contains("closed", F.col("b.bot")).alias("blocked"))


def access_findings(pages: DataFrame, report: DataFrame, llms: DataFrame) -> DataFrame:
    """page_id, finding, impact, rank: what keeps AI crawlers from reading a page, high impact first.

    ``pages`` has page_id, site, status, title, metas, scripts, json_ld_types and visible_text; ``report`` is a
    ``robots_report``; ``llms`` has site, status, content_type and text. A page has at most one finding of each kind.
    """
    table = access_table(report).where("blocked").groupBy("site").agg(F.bool_or(F.col("purpose") == "search").alias("search"))
    sites = report.select("site", "valid", F.size("sitemaps").alias("sitemaps")).join(table, "site", "left")
    files = llms.select("site", is_text_file(F.col("status"), F.col("content_type"), F.col("text")).alias("llms"))
    rows = pages.join(sites, "site", "left").join(files, "site", "left")
    words = F.when(F.coalesce("visible_text", F.lit("")) == "", 0).otherwise(F.size(F.split("visible_text", r"\s+")))
    valid, failed = F.coalesce("valid", F.lit(False)), (F.col("status") >= 400) | (F.coalesce("status", F.lit(0)) == 0)
    described = F.coalesce(F.trim(F.element_at("metas", "description")), F.lit("")) != ""
    impacts = [
        ("robots_invalid", F.when(~valid, "low")), ("robots_blocks", F.when(valid & F.col("search"), "high").when(valid & F.col("search").isNotNull(), "medium")),
        ("no_sitemap_line", F.when(valid & (F.col("sitemaps") == 0), "low")), ("no_llms", F.when(~F.coalesce("llms", F.lit(False)), "medium")),
        ("page_error", F.when(failed, "high")), ("js_shell", F.when(~failed & (words < 80) & (F.size("scripts") > 0), "high")),
        ("no_structured_data", F.when(F.size("json_ld_types") == 0, "high")), ("no_title", F.when(F.col("title") == "", "medium")), ("no_description", F.when(~described, "low")),
    ]
    found = F.array_compact(F.array(*[F.when(i.isNotNull(), F.struct(F.lit(f).alias("finding"), i.alias("impact"), F.lit(n).alias("ord"))) for n, (f, i) in enumerate(impacts)]))
    order = Window.partitionBy("page_id").orderBy(F.array_position(literals(("high", "medium", "low")), F.col("impact")), "ord")
    return rows.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*").withColumn("rank", F.row_number().over(order)).drop("ord")
