"""Issues of a site's crawled pages, one frame each. Pages have site, url, status, title, description, h1, words, noindex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THIN_WORDS = 150


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("status") > 0) & (F.col("status") < 400))


def error_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.coalesce("status", F.lit(0)) == 0) | (F.col("status") >= 400)).select("site", "url", "status")


def duplicate_values(pages: DataFrame, column: str) -> DataFrame:
    """site, value, pages of texts (trimmed, lower-cased, not empty) that several good pages share."""
    value = F.lower(F.trim(column))
    return good_pages(pages).groupBy("site", value.alias("value")).agg(F.count("*").alias("pages")).where("value <> '' and pages > 1")


def missing_values(pages: DataFrame, column: str) -> DataFrame:
    return good_pages(pages).where(F.coalesce(column, F.lit("")) == "").select("site", "url")


def h1_problems(pages: DataFrame) -> DataFrame:
    return good_pages(pages).where("h1 <> 1").select("site", "url", "h1")


def noindex_in_sitemap(pages: DataFrame, locs: DataFrame) -> DataFrame:
    listed = locs.select("site", F.col("loc").alias("url"))
    return good_pages(pages).where("noindex").join(listed, ["site", "url"], "left_semi").select("site", "url")


def thin_pages(pages: DataFrame) -> DataFrame:
    return good_pages(pages).where(F.col("words") < THIN_WORDS).select("site", "url", "words")


def weakest_pages(pages: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` good pages of the lowest score of each site (a report of that many rows)."""
    order = Window.partitionBy("site").orderBy("score", "url")
    ranked = good_pages(pages).select("site", "url", "score", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= top)
