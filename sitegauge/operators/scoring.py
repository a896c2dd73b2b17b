"""Scores, grades and ranked recommendations from checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.operators.page_checks import MODULES, SEVERITY_RANK, SEVERITY_WEIGHT, check, checks_of


def lookup(values: dict[str, int], column: str, otherwise: int) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(F.col(column) == k, v)
    return out.otherwise(otherwise)


def severity_weight(column: str = "severity") -> Column:
    return lookup(SEVERITY_WEIGHT, column, 1)


def severity_rank(column: str = "severity") -> Column:
    return lookup(SEVERITY_RANK, column, 0)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def module_scores(checks: DataFrame, by: str = "page_id") -> DataFrame:
    """Share of the weight of a module's checks that pass, in per cent; skipped checks don't count."""
    counted = F.when(F.col("status") != "skip", severity_weight())
    earned = F.when(F.col("status") == "pass", severity_weight()).otherwise(0)
    share = half_up(100 * F.sum(earned) / F.sum(counted))
    return checks.groupBy(by, "module").agg(F.coalesce(share, F.lit(100).cast("long")).alias("score"))


def overall_scores(scores: DataFrame, by: str = "page_id") -> DataFrame:
    """Weighted mean of the modules' scores, and its grade."""
    weight = lookup(dict(MODULES), "module", 0)
    mean = scores.groupBy(by).agg(half_up(F.sum(F.col("score") * weight) / F.sum(weight)).alias("overall"))
    at = F.col("overall")
    grade = F.when(at >= 90, "Excellent").when(at >= 70, "Good").when(at >= 50, "Needs Attention").otherwise("Critical")
    return mean.withColumn("grade", grade)


def scoring_checks(overall: DataFrame, counts: DataFrame, by: str = "page_id") -> DataFrame:
    """The checks of the scoring module: the overall score, and that nothing critical fails. Neither enters a score."""
    m, both = "scoring", overall.join(counts, by)
    at, critical = F.col("overall"), F.col("critical")
    return checks_of(both, [
        check(m, "scoring.overall", (at >= 70, None), (at >= 50, "warning"), (F.lit(True), "critical"), value=at),
        check(m, "scoring.critical_count", (critical > 0, "critical"), value=critical),
    ], by)


def site_scores(overall: DataFrame, pages: DataFrame) -> DataFrame:
    """site, pages, average: the mean score of a site's pages, to the nearest whole."""
    return pages.select("site", "page_id").join(overall, "page_id").groupBy("site").agg(F.count("*").alias("pages"), half_up(F.avg("overall")).alias("average"))


def severity_counts(checks: DataFrame, by: str = "page_id") -> DataFrame:
    fail = F.col("status") == "fail"
    of = lambda *s: F.count_if(fail & F.col("severity").isin(*s))
    return checks.groupBy(by).agg(
        of("critical").alias("critical"), of("warning").alias("warnings"), of("notice", "info").alias("notices"), F.count_if(F.col("status") == "pass").alias("passes")
    )


def recommendations(checks: DataFrame, by: str = "page_id", top: int | None = None) -> DataFrame:
    """Failed checks ranked within each page: the greatest impact first, then by id."""
    order = Window.partitionBy(by).orderBy(F.desc("impact"), "check_id", "module")
    failed = checks.where("status = 'fail'").withColumn("impact", severity_weight().cast("long"))
    ranked = failed.select(by, "module", "check_id", "severity", "impact", F.row_number().over(order).alias("rank"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
