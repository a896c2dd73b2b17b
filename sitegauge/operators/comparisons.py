"""Comparisons of sites, periods and runs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.operators.scoring import lookup, severity_rank, severity_weight

#: Days that search data lag behind.
LAG_DAYS = 3


def site_checks(checks: DataFrame, site: str = "site") -> DataFrame:
    """site, module, check_id, status, severity over all pages of a site: one failing page fails the site, at its worst."""
    fails = F.col("status") == "fail"
    worst = F.max_by("severity", F.when(fails, severity_rank()))
    status = F.when(F.bool_or(fails), "fail").when(F.bool_or(F.col("status") == "pass"), "pass").otherwise("skip")
    return checks.groupBy(site, "module", "check_id").agg(status.alias("status"), F.coalesce(worst, F.lit("info")).alias("severity"))


def gap_report(checks: DataFrame, you: str, site: str = "site") -> DataFrame:
    """kind (gap, open ground, edge), module, check_id, severity, passing, failing, weight, rank.

    ``checks`` has one row for each site and check. Your check meets the same check of every rival: passing and
    failing count the rivals, so that no row grows with their number; ``gap_sites`` names them. You fail what rivals
    pass: a gap; all fail: open ground; you pass what rivals fail: an edge. The worst severity of any failure holds.
    """
    key = ["module", "check_id"]
    mine = checks.where(F.col(site) == you).select(*key, F.col("status").alias("mine"), F.col("severity").alias("my_severity")).where("mine <> 'skip'")
    rivals = checks.where((F.col(site) != you) & (F.col("status") != "skip")).withColumn("rank", severity_rank())
    fails = F.col("status") == "fail"
    theirs = rivals.groupBy(*key).agg(
        F.count_if(F.col("status") == "pass").alias("passing"), F.count_if(fails).alias("failing"),
        F.max(F.when(fails, F.col("rank"))).alias("their_rank"), F.max_by("severity", F.when(fails, F.col("rank"))).alias("their_severity"),
    )
    both = mine.join(theirs, key)
    my_rank = F.when(F.col("mine") == "fail", lookup({"critical": 3, "warning": 2, "notice": 1}, "my_severity", 0)).otherwise(-1)
    severity = F.when(my_rank >= F.coalesce("their_rank", F.lit(-1)), F.when(my_rank >= 0, F.col("my_severity"))).otherwise(F.col("their_severity"))
    both = both.withColumn("severity", F.coalesce(severity, F.lit("notice")))
    kind = (
        F.when((F.col("mine") == "fail") & (F.col("passing") > 0), "gap")
        .when(F.col("mine") == "fail", "open_ground")
        .when((F.col("mine") == "pass") & (F.col("failing") > 0), "edge")
    )
    times = F.when(kind == "gap", F.col("passing")).when(kind == "edge", F.col("failing")).otherwise(1)
    rows = both.select(kind.alias("kind"), *key, "severity", "passing", "failing", (severity_weight() * times).cast("long").alias("weight")).where("kind is not null")
    order = Window.partitionBy("kind").orderBy(F.desc("weight"), F.desc(severity_rank()), *key)  # at most one row per check
    return rows.withColumn("rank", F.row_number().over(order))


def gap_sites(checks: DataFrame, report: DataFrame, you: str, site: str = "site") -> DataFrame:
    """kind, module, check_id, site, status: the rivals that a row of the report counts."""
    rivals = checks.where((F.col(site) != you) & (F.col("status") != "skip")).select("module", "check_id", site, "status")
    return rivals.join(F.broadcast(report.select("kind", "module", "check_id")), ["module", "check_id"]).select("kind", "module", "check_id", site, "status")


def score_matrix(scores: DataFrame, sites: list[str], site: str = "site") -> DataFrame:
    """One row per module, one column per site; a missing score is null."""
    return scores.groupBy("module").pivot(site, sites).agg(F.first("score"))


def periods(today: date, days: int = 28) -> tuple[tuple[date, date], tuple[date, date]]:
    """The last full period and the one of equal length before it."""
    end = today - timedelta(days=LAG_DAYS)
    start = end - timedelta(days=days - 1)
    return (start, end), (start - timedelta(days=days), start - timedelta(days=1))


def period_metrics(hits: DataFrame, current: tuple[date, date], previous: tuple[date, date], key: str, day: str = "day") -> DataFrame:
    """key, clicks, impressions, position now and their changes; ``new`` marks keys without a previous row.

    ``hits`` has clicks, impressions and position sums by day. One aggregate reads both periods.
    """
    now = F.col(day).between(*[F.lit(d) for d in current])
    before = F.col(day).between(*[F.lit(d) for d in previous])
    of = lambda when, c: F.sum(F.when(when, F.col(c)))
    sums = hits.where(now | before).groupBy(key).agg(
        *[of(w, c).alias(f"{p}{c}") for p, w in (("", now), ("previous_", before)) for c in ("clicks", "impressions", "weighted_position")],
        F.count_if(now).alias("__now"), F.count_if(before).alias("__before"),
    )
    mean = lambda prefix: F.col(f"{prefix}weighted_position").cast("double") / F.col(f"{prefix}impressions")
    position, earlier = mean(""), mean("previous_")
    return sums.where("__now > 0").select(
        key, "clicks", "impressions", (F.col("clicks") / F.col("impressions")).alias("ctr"), F.round(position, 6).alias("position"),
        (F.col("clicks") - F.col("previous_clicks")).alias("clicks_change"),
        (F.floor(F.round(position - earlier, 6) * 10 + 0.5) / 10).alias("position_change"),
        (F.col("__before") == 0).alias("new"),
    )


def period_totals(hits: DataFrame, current: tuple[date, date], previous: tuple[date, date], day: str = "day") -> DataFrame:
    """clicks, impressions and previous_clicks of all keys, in one row; 0 for none."""
    of = lambda period, c: F.coalesce(F.sum(F.when(F.col(day).between(*[F.lit(d) for d in period]), F.col(c))), F.lit(0)).cast("long")
    return hits.agg(of(current, "clicks").alias("clicks"), of(current, "impressions").alias("impressions"), of(previous, "clicks").alias("previous_clicks"))


def signed(n: Column) -> Column:
    """A change as text: ``new`` for null, a plus before what is above 0."""
    return F.when(n.isNull(), "new").when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def property_name(site: Column) -> Column:
    """How search data name a site: a domain property, or a url prefix that ends with a slash."""
    own = F.trim(site)
    url = F.when(own.endswith("/"), own).otherwise(F.concat(own, F.lit("/")))
    domain = F.concat(F.lit("sc-domain:"), F.regexp_replace(F.regexp_replace(own, r"^www\.", ""), "/.*$", ""))
    return F.when(own.rlike("(?i)^sc-domain:"), own).when(own.rlike("(?i)^https?://"), url).otherwise(domain)


def index_status(inspections: DataFrame) -> DataFrame:
    """url and the eight fields of an inspection's answer (a JSON text, ``answer``); an absent verdict is UNKNOWN."""
    fields = {
        "verdict": "verdict", "coverage": "coverageState", "last_crawl": "lastCrawlTime", "google_canonical": "googleCanonical", "user_canonical": "userCanonical",
        "robots_txt": "robotsTxtState", "indexing_allowed": "indexingState", "page_fetch": "pageFetchState",
    }
    found = {k: F.nullif(F.get_json_object("answer", f"$.inspectionResult.indexStatusResult.{v}"), F.lit("")) for k, v in fields.items()}
    return inspections.select("url", F.coalesce(found.pop("verdict"), F.lit("UNKNOWN")).alias("verdict"), *[v.alias(k) for k, v in found.items()])


def submitted_sitemaps(files: DataFrame) -> DataFrame:
    """path, errors, warnings and submitted, the sum over a file's ``contents`` (array of structs with ``submitted`` as text)."""
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    total = F.aggregate(F.coalesce("contents", F.array().cast("array<struct<submitted:string>>")), F.lit(0).cast("long"), lambda n, c: n + number(c["submitted"]))
    return files.select("path", number(F.col("errors")).alias("errors"), number(F.col("warnings")).alias("warnings"), total.alias("submitted"))


def rank_changes(now: DataFrame, before: DataFrame, key: str = "key", move: int = 3) -> DataFrame:
    """key, level, change of keys that are new, gone, or moved by ``move`` places or more."""
    joined = now.select(key, F.col("position").alias("p")).join(before.select(key, F.col("position").alias("b")), key, "full")
    step = F.col("p") - F.col("b")
    change = (
        F.when(F.col("b").isNull(), "new").when(F.col("p").isNull(), "lost").when(step <= -move, "up").when(step >= move, "down")
    )
    level = F.when(change.isin("new", "up"), "good").otherwise("warn")
    return joined.select(key, level.alias("level"), change.alias("change"), F.col("p").alias("position"), F.col("b").alias("previous_position")).where("change is not null")


def map_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """query, level, change of places (query, position or null, reviews) that both runs asked for."""
    b = before.select("query", F.col("position").alias("b"), F.col("reviews").alias("br"))
    joined = now.join(b, "query")
    p, q = F.col("position"), F.col("b")
    row = lambda level, change: F.struct(F.lit(level).alias("level"), F.lit(change).alias("change"))
    moved = (
        F.when(q.isNull() & p.isNotNull(), row("good", "appeared"))
        .when(q.isNotNull() & p.isNull(), row("alert", "dropped_out"))
        .when(p < q, row("good", "up"))
        .when(p > q, row("warn", "down"))
    )
    reviewed = F.when(F.col("reviews") != F.col("br"), row("good", "reviews"))
    return joined.select("query", F.explode(F.array_compact(F.array(moved, reviewed))).alias("c")).select("query", "c.*")


def set_changes(now: DataFrame, before: DataFrame, key: list[str], new_level: str, gone_level: str | None) -> DataFrame:
    """Rows that are only in one of two runs, by anti-joins both ways; ``gone_level`` null leaves out the gone."""
    new = now.select(*key).distinct().join(before, key, "left_anti").withColumns({"level": F.lit(new_level), "change": F.lit("new")})
    if gone_level is None:
        return new
    gone = before.select(*key).distinct().join(now, key, "left_anti").withColumns({"level": F.lit(gone_level), "change": F.lit("gone")})
    return new.unionByName(gone)


def score_moves(runs: DataFrame, by: str, order: str, score: str = "avg_score", least: int = 5) -> DataFrame:
    """Every run whose score moved by ``least`` or more against the run before."""
    earlier = F.lag(score).over(Window.partitionBy(by).orderBy(order))
    moved = runs.withColumn("previous", earlier).withColumn("step", F.col(score) - F.col("previous"))
    return moved.where(F.abs("step") >= least).select(by, order, score, "previous", F.when(F.col("step") > 0, "good").otherwise("warn").alias("level"))


def latest_before(snapshots: DataFrame, by: list[str], ts: str, now) -> DataFrame:
    """The last snapshot of each key before ``now`` (an as-of lookup), combined before the shuffle."""
    rest = [c for c in snapshots.columns if c not in by]
    last = snapshots.where(F.col(ts) < F.lit(now)).groupBy(*by).agg(F.max_by(F.struct(*rest), ts).alias("s"))
    return last.select(*by, "s.*")


def local_results(places: DataFrame, query: str = "query") -> DataFrame:
    """One row per query: your position, listings, median reviews of the others, and two counts.

    ``places`` has query, ord, reviews, website and you (see ``is_you``). The median is exact, 0 for none.
    """
    numbered = places.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("ord")))
    reviews = F.coalesce("reviews", F.lit(0))
    other = ~F.col("you")
    return numbered.groupBy(query).agg(
        F.min(F.when(F.col("you"), F.col("position"))).alias("position"), F.count("*").alias("total"),
        F.coalesce(F.median(F.when(other, reviews)), F.lit(0.0)).alias("review_median"),
        F.count_if(other & (reviews < 5)).alias("under_5_reviews"),
        F.count_if(F.coalesce("website", F.lit("")) == "").alias("without_website"),
    )


def business_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def bare_host(url: Column) -> Column:
    """The host of a url without a leading ``www.``; null without one."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def is_you(name: Column, website: Column, your_name: Column, your_website: Column) -> Column:
    """Whether a listing is yours: the same host, or your name as whole words of its name."""
    site = F.when(your_website.rlike("(?i)^https?:"), your_website).otherwise(F.concat(F.lit("https://"), your_website))
    theirs, yours = F.concat(F.lit(" "), business_name(name), F.lit(" ")), business_name(your_name)
    named = (yours != "") & F.contains(theirs, F.concat(F.lit(" "), yours, F.lit(" ")))
    return F.coalesce(bare_host(website) == bare_host(site), F.lit(False)) | named
