"""Queries over page views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.times import within_days
from dayloom.functions.urls import authority


def filtered(views: DataFrame, start: str, end: str, browser: str | None = None, profile: str | None = None) -> DataFrame:
    """Page views of the days from ``start`` to ``end``, of one browser and profile where given."""
    rows = views.where(within_days(F.col("started_at_utc"), start, end))
    for column, value in (("browser", browser), ("profile", profile)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def page_views(views: DataFrame, start: str, end: str, browser: str | None = None, profile: str | None = None, limit: int = 50) -> DataFrame:
    """The latest page views, ties by id."""
    rows = filtered(views, start, end, browser, profile)
    columns = ["page_view_id", "started_at_utc", "ended_at_utc", "url", "title", "browser", "profile", "transition", "visit_span_count"]
    return rows.select(*columns).orderBy(F.desc("started_at_utc"), F.asc_nulls_last("page_view_id")).limit(limit)


def top_domains(views: DataFrame, start: str, end: str, browser: str | None = None, profile: str | None = None, limit: int = 20) -> DataFrame:
    """The most viewed domains; views without one do not count."""
    rows = filtered(views, start, end, browser, profile).select(authority(F.col("url")).alias("domain"), "url").where("domain IS NOT NULL")
    found = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("page_view_count"), F.count_distinct("url").alias("unique_urls"))
    return found.orderBy(F.desc("page_view_count"), F.desc("unique_urls"), F.asc_nulls_last("domain")).limit(limit)
