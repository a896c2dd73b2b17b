"""Which pages of a site to look at: sitemaps and their indexes, links of the start page, robots rules, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.urls import origins, resolved
from sitegauge.operators.robots import locations, urls_allowed
from sitegauge.sources.staging import staged

#: Sitemap files that are opened for a site; urls that are gathered, as a multiple of the pages wanted.
MOST_FILES, GATHERED = 10, 4
COMPRESSED = r"(?i)\.gz($|\?)"


def is_sitemap(status: Column, text: Column) -> Column:
    return (status == 200) & text.rlike(r"(?i)<(urlset|sitemapindex)\b")


def sitemap_tests(files: DataFrame) -> DataFrame:
    """url, ok, locs: whether a fetched file begins like a sitemap, and how many locations it lists."""
    ok = (F.col("status") == 200) & F.substring(F.coalesce("text", F.lit("")), 1, 500).rlike(r"(?i)<(urlset|sitemapindex)\b")
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?i)<loc>")).cast("long")
    return files.select("url", F.coalesce(ok, F.lit(False)).alias("ok"), F.when(F.coalesce(ok, F.lit(False)), count).otherwise(0).alias("locs"))


def sitemap_starts(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """site, ord, url of the sitemaps to begin with: those that robots.txt declares, else ``/sitemap.xml`` of the site's origin.

    ``sites`` has site and url of a page; ``declared`` has site, line_no and sitemap.
    """
    named = declared.select("site", F.col("line_no").cast("long").alias("ord"), F.col("sitemap").alias("url"))
    usual = sites.join(declared.select("site").distinct(), "site", "left_anti").select("site", F.lit(0).cast("long").alias("ord"), F.concat(origins(F.col("url")), F.lit("/sitemap.xml")).alias("url"))
    return named.unionByName(usual)


def sitemap_facts(files: DataFrame) -> DataFrame:
    """url, usable, index, many, next of sitemap files: ``next`` are the first different files that an index lists.

    Not more of them can ever be opened, as a site has seen MOST_FILES at most.
    """
    text = F.coalesce("text", F.lit(""))
    index, own = text.rlike(r"(?i)<sitemapindex\b"), locations(text)
    found = files.select("url", is_usable(F.col("url"), F.col("status"), text).alias("usable"), index.alias("index"), own.alias("locs"))
    next_ = F.when(F.col("index"), F.slice(F.array_distinct("locs"), 1, 2 * MOST_FILES)).otherwise(F.array().cast("array<string>"))
    return found.select("url", "usable", "index", F.size("locs").cast("long").alias("many"), next_.alias("next"))


def is_usable(url: Column, status: Column, text: Column) -> Column:
    """A sitemap that was fetched and is not compressed."""
    return F.coalesce(is_sitemap(status, text) & ~url.rlike(COMPRESSED), F.lit(False))


def opened_sitemaps(starts: DataFrame, files: DataFrame, pages: int) -> DataFrame:
    """site, file, url, before of the files that each site opens, in order; ``before`` is how many urls it had gathered by then.

    ``starts`` has site, ord and url; ``files`` has url, status and text, one row for each url. A site's files are a queue: those declared, then what each opened index lists.
    Every round opens the next file of each site that has opened fewer than MOST_FILES and gathered fewer than GATHERED times ``pages`` urls. A site is one small row
    (its queue, cut to the files that it can still open, the files opened, the urls gathered), which each round joins to the files once.
    """
    order = Window.partitionBy("site").orderBy("ord", "url")
    first = starts.groupBy("site", "url").agg(F.min("ord").alias("ord")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_FILES)
    queue = F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"])
    none = F.array().cast("array<struct<url:string,before:bigint>>")
    state = first.groupBy("site").agg(queue.alias("queue")).select("site", "queue", none.alias("opened"), F.lit(0).cast("long").alias("gathered"))
    facts = staged(sitemap_facts(files)).withColumnRenamed("url", "next_url")  # texts are read once, not in every round
    for _ in range(MOST_FILES):
        asked = state.withColumn("next_url", F.when(F.col("gathered") < GATHERED * pages, F.get("queue", F.lit(0))))
        read = asked.join(facts, "next_url", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
        going, item = F.col("next_url").isNotNull(), F.struct(F.col("next_url").alias("url"), F.col("gathered").alias("before"))
        more = F.when(F.col("usable") & F.col("index"), F.col("next")).otherwise(F.array().cast("array<string>"))
        read = read.select("site", "gathered", "queue", going.alias("going"), more.alias("more"), F.when(going, F.concat("opened", F.array(item))).otherwise(F.col("opened")).alias("opened"),
                           F.when(F.col("usable") & ~F.col("index"), F.col("many")).otherwise(0).alias("gain"))
        rest = F.array_except(F.concat(F.slice("queue", 2, MOST_FILES), "more"), F.transform("opened", lambda x: x["url"]))
        state = read.select("site", F.when(F.col("going"), F.slice(rest, 1, MOST_FILES)).otherwise(F.col("queue")).alias("queue"), "opened", (F.col("gathered") + F.col("gain")).alias("gathered"))
    return state.select("site", F.posexplode("opened").alias("file", "o")).select("site", "file", "o.url", "o.before")


def expand_sitemaps(starts: DataFrame, files: DataFrame, pages: int) -> DataFrame:
    """site, ord, loc: the urls that the sitemaps of each site list, those that ``opened_sitemaps`` opens."""
    text = F.coalesce("text", F.lit(""))
    lists = files.where(is_usable(F.col("url"), F.col("status"), text) & ~text.rlike(r"(?i)<sitemapindex\b"))
    listed = lists.select("url", F.posexplode(locations(text)).alias("n", "loc"))
    return opened_sitemaps(starts, files, pages).join(listed, "url").select("site", (F.col("before") + F.col("n")).alias("ord"), "loc")


def candidates(starts: DataFrame, locs: DataFrame, links: DataFrame, rules: DataFrame, token: str = "*") -> DataFrame:
    """site, url, ord, source, kind, times: the start page and what its sitemaps or, without any urls in them, its links list.

    Urls are seen from the start page's origin, in one spelling and without their fragment; those that are none are left out. kind is offsite for those of another origin, blocked
    for those that robots rules keep out, else found. Repeated ones are one row, where they first occur. ``starts`` has site and url; ``locs`` and ``links`` have site, ord
    and loc.
    """
    others = links.join(locs.select("site").distinct(), "site", "left_anti").select("site", "ord", "loc", F.lit("links").alias("source"))
    every = locs.select("site", F.col("ord").cast("long").alias("ord"), "loc", F.lit("sitemap").alias("source")).unionByName(others)
    every = every.unionByName(starts.select("site", F.lit(-1).cast("long").alias("ord"), F.col("url").alias("loc"), F.lit("start").alias("source")))
    seen = every.join(starts.select("site", origins(F.col("url")).alias("home")), "site")
    seen = seen.withColumn("url", resolved(F.col("loc"), F.col("home"), fragment=False)).where("url is not null")
    first = seen.groupBy("site", "url", "home").agg(F.min(F.struct("ord", "source")).alias("f"), F.count("*").alias("times"))
    here = F.coalesce(origins(F.col("url")) == F.col("home"), F.lit(False))
    asked = first.select("site", "url", "f.*", "times", here.alias("here"), F.when(here, F.regexp_extract("url", "^[^:]+://[^/]*(.*)$", 1)).alias("path"))
    allowed = urls_allowed(asked.where("here").select("site", "url", "path"), rules, token).select("site", "url", "allowed")
    kind = F.when(~F.col("here"), "offsite").when(~F.col("allowed"), "blocked").otherwise("found")
    return asked.join(allowed, ["site", "url"], "left").select("site", "url", "ord", "source", kind.alias("kind"), "times")


def capped(every: DataFrame, pages: int) -> DataFrame:
    """site, rank, url, source of the first ``pages`` of the candidates found on each site (a limit of the crawl)."""
    order = Window.partitionBy("site").orderBy("ord", "url")
    kept = every.where("kind = 'found'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pages)
    return kept.select("site", "rank", "url", "source")


def discover(starts: DataFrame, locs: DataFrame, links: DataFrame, rules: DataFrame, pages: int, token: str = "*") -> DataFrame:
    """site, rank, url, source: the start page and then its candidates, ``pages`` of each site. See ``candidates``."""
    return capped(candidates(starts, locs, links, rules, token), pages)


def discovery_reports(every: DataFrame) -> DataFrame:
    """site, source, found, blocked, offsite: where candidates come from, and how many there are of each kind (offsite ones with repeats)."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    source = F.when(F.bool_or(F.col("source") == "sitemap"), "sitemap").otherwise("links")
    offsite = F.sum(F.when(F.col("kind") == "offsite", F.col("times")).otherwise(0)).alias("offsite")
    return every.groupBy("site").agg(source.alias("source"), of("found").alias("found"), of("blocked").alias("blocked"), offsite)


def page_links(facts: DataFrame) -> DataFrame:
    """page_id, ord, loc of the internal links of a page, without fragments."""
    own = F.filter("links", lambda x: x["internal"] & ~x["is_anchor"] & x["resolved"].isNotNull())
    return facts.select("page_id", F.posexplode(F.transform(own, lambda x: F.regexp_replace(x["resolved"], "#.*$", ""))).alias("ord", "loc"))
