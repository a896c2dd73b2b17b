"""robots.txt and sitemap texts as tables, and which crawlers and urls they let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """site, line_no, key, value of the lines that hold a key; comments are dropped, keys lower-cased."""
    lines = files.select("site", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("line_no", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    cut = F.instr(bare, ":")
    parts = lines.select("site", "line_no", bare.alias("b"), cut.alias("at")).where("at > 0")
    return parts.select("site", "line_no", F.lower(F.trim(F.expr("substring(b, 1, at - 1)"))).alias("key"), F.trim(F.expr("substring(b, at + 1)")).alias("value"))


def robots_rules(files: DataFrame, text: str = "text") -> DataFrame:
    """site, group_no, agent, rule_no, type, path: one row per agent of a group and rule.

    Agent lines in a row share a group; rules before any agent line are a group for ``*``. A group without
    rules gives one row with a null type. Windows run within a site's file.
    """
    order = Window.partitionBy("site").orderBy("line_no")
    lines = robots_lines(files, text).where("key in ('user-agent', 'allow', 'disallow')")
    agent = F.col("key") == "user-agent"
    opens = agent & (F.coalesce(F.lag("key").over(order), F.lit("disallow")) != "user-agent")
    lines = lines.withColumn("group_no", F.sum(opens.cast("int")).over(order))
    agents = lines.where("key = 'user-agent'").select("site", "group_no", F.lower("value").alias("agent"))
    starless = lines.where("group_no = 0").select("site", "group_no", F.lit("*").alias("agent")).distinct()
    rules = lines.where("key <> 'user-agent'").select("site", "group_no", F.col("line_no").alias("rule_no"), F.col("key").alias("type"), F.col("value").alias("path"))
    return agents.unionByName(starless).distinct().join(rules, ["site", "group_no"], "left").select("site", "group_no", "agent", "rule_no", "type", "path")


def robots_sitemaps(files: DataFrame, text: str = "text") -> DataFrame:
    return robots_lines(files, text).where("key = 'sitemap'").select("site", "line_no", F.col("value").alias("sitemap"))


def crawler_access(rules: DataFrame, crawlers: DataFrame, sites: DataFrame) -> DataFrame:
    """site, bot, blocked: whether the root is disallowed and not allowed for a crawler.

    The groups that name the crawler count; without any, those of ``*``; without these it is let in.
    ``crawlers`` is a small table of bots, which every site's rules meet by an equi-join on the agent.
    """
    root = F.col("path").isin("/", "/*")
    verdict = rules.groupBy("site", "agent").agg(
        (F.coalesce(F.bool_or((F.col("type") == "disallow") & root), F.lit(False)) & ~F.coalesce(F.bool_or((F.col("type") == "allow") & root), F.lit(False))).alias("blocked")
    )
    wanted = sites.select("site").distinct().withColumn("bot", F.explode(F.array(*[F.lit(r["bot"]) for r in crawlers.select("bot").collect()])))
    own = verdict.select("site", F.col("agent").alias("own"), F.col("blocked").alias("own_blocked"))
    star = verdict.where("agent = '*'").select("site", F.col("blocked").alias("star_blocked"))
    joined = wanted.withColumn("own", F.lower("bot")).join(own, ["site", "own"], "left").join(star, "site", "left")
    return joined.select("site", "bot", F.coalesce("own_blocked", "star_blocked", F.lit(False)).alias("blocked"))


def path_pattern(path: str) -> Column:
    """A rule's path as a regular expression: ``*`` matches anything, a last ``$`` ends the url."""
    escaped = F.regexp_replace(F.col(path), r"([.+?^${}()|\[\]\\])", r"\\$1")
    open_ = F.regexp_replace(escaped, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(open_, r"\\\$$", r"\$"))


def applying_rules(rules: DataFrame, token: str = "*") -> DataFrame:
    """site, type, path, literal, wild, pattern of the rules of the token's groups, else of those of ``*``; empty ones are left out.

    ``literal`` is what a path begins with that the rule matches: all of the rule up to its first wildcard.
    """
    named = rules.where(F.col("agent") == token.lower()).select("site").distinct().withColumn("named", F.lit(True))
    chosen = rules.join(named, "site", "left").where(F.col("agent") == F.when(F.col("named"), F.lit(token.lower())).otherwise("*")).where("path <> ''")
    literal = F.regexp_replace("path", r"\*.*$|\$$", "")
    return chosen.select("site", "type", "path", literal.alias("literal"), (literal != F.col("path")).alias("wild"), path_pattern("path").alias("pattern")).distinct()


def rule_pairs(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The pairs of a path and a rule of its site that begins like it: those that are looked at at all.

    A site's rules have few different lengths of their literal beginnings. Each path is cut at those lengths only, and its beginnings meet the
    rules as equal keys, which spread over tasks however many paths and rules a site has.
    """
    lengths = rules.groupBy("site").agg(F.collect_set(F.char_length("literal")).alias("lengths"))
    cut = paths.join(lengths, "site").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))))
    return cut.withColumn("literal", F.substring("path", F.lit(1), F.col("n"))).drop("lengths", "n").join(rules.withColumnRenamed("path", "rule"), ["site", "literal"])


def urls_allowed(urls: DataFrame, rules: DataFrame, token: str = "*") -> DataFrame:
    """site, url, path, allowed. The longest matching rule of the token's groups (else those of ``*``) decides.

    An allow wins a tie, empty disallows are ignored, and a path that no rule matches is allowed, a null one not. Paths
    fetch rules by their literal beginnings (``rule_pairs``), and only rules with wildcards then run a pattern. The best rule of each url is kept by
    an aggregate that is combined before the shuffle.
    """
    pairs = rule_pairs(urls.select("site", "url", "path").distinct(), applying_rules(rules, token))
    matched = pairs.where(~F.col("wild") | F.regexp_like("path", "pattern"))
    best = F.max(F.struct(F.char_length("rule").alias("n"), (F.col("type") == "allow").alias("allow")))
    decided = matched.groupBy("site", "url").agg(best.alias("best"))
    return urls.join(decided, ["site", "url"], "left").select("site", "url", "path", F.coalesce("best.allow", F.col("path").isNotNull()).alias("allowed"))


#: A location of a sitemap; what holds white space, a bracket or a tag is none.
LOCATION = r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)\s*(?:\]\]>)?\s*</loc>"


def locations(text: Column) -> Column:
    """The locations in a sitemap's text in order; CDATA is taken off and ``&amp;`` decoded."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOCATION), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def sitemap_locs(files: DataFrame, text: str = "text") -> DataFrame:
    """site, ord, loc of every location of a sitemap."""
    return files.select("site", F.posexplode(locations(F.col(text))).alias("ord", "loc"))
