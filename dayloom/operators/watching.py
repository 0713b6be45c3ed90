"""Watch events from page views and exports, and their enrichment from master data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions import urls
from dayloom.functions.ids import uuid5
from dayloom.functions.times import exported_time, instant, iso_duration
from dayloom.functions.values import or_else, present, safe_long

EVENT_PREFIX = "youtube_watch_event_"


def watch_events(page_views: DataFrame) -> DataFrame:
    """Events of page views that show a video and have a title."""
    url = F.col("url")
    rows = page_views.withColumns({"_video": urls.video_id(url), "_page": urls.video_page(url)})
    rows = rows.where(F.col("_video").isNotNull() & F.col("_page").isNotNull() & (F.col("title") != ""))
    name = F.concat_ws(":", F.lit("browser_history"), "page_view_id", "_video")
    return rows.select(
        F.concat(F.lit(EVENT_PREFIX), uuid5(name)).alias("watch_event_id"),
        F.col("started_at_utc").alias("watched_at_utc"),
        F.col("_video").alias("video_id"),
        F.col("_page").alias("video_url"),
        F.col("title").alias("video_title"),
        F.lit(None).cast("string").alias("channel_id"),
        F.lit(None).cast("string").alias("channel_name"),
        urls.content_type(url).alias("content_type"),
        F.lit("browser_history").alias("source"),
        F.col("page_view_id").alias("source_event_id"),
        "source_device",
        "ingested_at_utc",
        F.col("sync_id").alias("browser_history_sync_id"),
    )


def enrich(events: DataFrame, videos: DataFrame) -> DataFrame:
    """Events with title and channel of the master where that has them; empty text falls through as null does."""
    v = videos.select(F.col("video_id"), *[F.col(c).alias(f"_v_{c}") for c in ("title", "channel_id", "channel_name")])
    joined = events.join(v, "video_id", "left")
    new = {"video_title": or_else(F.col("_v_title"), F.col("video_title")), "channel_id": or_else(F.col("_v_channel_id"), F.col("channel_id")), "channel_name": or_else(F.col("_v_channel_name"), F.col("channel_name"))}
    return joined.withColumns(new).drop("_v_title", "_v_channel_id", "_v_channel_name").select(*events.columns)


def video_ids(events: DataFrame) -> DataFrame:
    """Distinct ids in order, each with the content type of its events (``video`` unless all say otherwise)."""
    kind = F.coalesce(F.max("content_type"), F.lit("video"))
    return events.where(present(F.col("video_id"))).groupBy("video_id").agg(kind.alias("content_type")).orderBy("video_id")


def _thumbnail(thumbnails: str) -> Column:
    return or_else(*[F.col(f"{thumbnails}.{q}.url") for q in ("high", "medium", "default")])


THUMBNAILS = "struct<high:struct<url:string>,medium:struct<url:string>,default:struct<url:string>>"
#: The fields that are read from the video service's answers.
VIDEO_ITEM = (
    f"id string, snippet struct<title:string,channelId:string,channelTitle:string,publishedAt:string,description:string,categoryId:string,tags:array<string>,thumbnails:{THUMBNAILS}>, "
    "contentDetails struct<duration:string>, statistics struct<viewCount:string,likeCount:string,commentCount:string>"
)
CHANNEL_ITEM = f"id string, snippet struct<title:string,publishedAt:string,description:string,country:string,thumbnails:{THUMBNAILS}>, statistics struct<subscriberCount:string,videoCount:string,viewCount:string>"


def videos(items: DataFrame, updated_at: Column) -> DataFrame:
    """Video master rows of items (``VIDEO_ITEM``)."""
    s = "snippet"
    return items.select(
        F.col("id").alias("video_id"), F.col(f"{s}.title").alias("title"), F.col(f"{s}.channelId").alias("channel_id"), F.col(f"{s}.channelTitle").alias("channel_name"),
        iso_duration(F.col("contentDetails.duration")).alias("duration_seconds"),
        *[safe_long(F.col(f"statistics.{a}")).alias(b) for a, b in (("viewCount", "view_count"), ("likeCount", "like_count"), ("commentCount", "comment_count"))],
        instant(F.col(f"{s}.publishedAt")).alias("published_at"), _thumbnail(f"{s}.thumbnails").alias("thumbnail_url"), F.col(f"{s}.description").alias("description"),
        F.col(f"{s}.categoryId").alias("category_id"), F.col(f"{s}.tags").alias("tags"), updated_at.alias("updated_at"),
    )


def channels(items: DataFrame, updated_at: Column) -> DataFrame:
    """Channel master rows of items (``CHANNEL_ITEM``)."""
    s = "snippet"
    return items.select(
        F.col("id").alias("channel_id"), F.col(f"{s}.title").alias("channel_name"),
        *[safe_long(F.col(f"statistics.{a}")).alias(b) for a, b in (("subscriberCount", "subscriber_count"), ("videoCount", "video_count"), ("viewCount", "view_count"))],
        instant(F.col(f"{s}.publishedAt")).alias("published_at"), _thumbnail(f"{s}.thumbnails").alias("thumbnail_url"), F.col(f"{s}.description").alias("description"),
        F.col(f"{s}.country").alias("country"), updated_at.alias("updated_at"),
    )


def watch_history(items: DataFrame, account: str) -> DataFrame:
    """Watch history rows of activity items (video_id, title, channel_name, watched_at text, video_url) that have all they need."""
    rows = items.withColumn("_at", instant(F.col("watched_at"))).where(present(F.col("video_id"), F.col("title"), F.col("channel_name")) & F.col("_at").isNotNull())
    stamp = F.concat(F.date_format("_at", "yyyy-MM-dd HH:mm:ss"), F.when(F.pmod(F.unix_micros("_at"), F.lit(1_000_000)) == 0, F.lit("")).otherwise(F.date_format("_at", ".SSSSSS")), F.lit("+00:00"))
    return rows.select(
        F.sha2(F.concat_ws("_", F.lit(account), "video_id", stamp), 256).substr(1, 16).alias("watch_id"), F.lit(account).alias("account_id"), F.col("_at").alias("watched_at_utc"),
        "video_id", F.col("title").alias("video_title"), F.lit(None).cast("string").alias("channel_id"), "channel_name", "video_url", F.lit(None).cast("string").alias("context"),
    )


def exported_events(pages: DataFrame, ingested_at: Column, html: str = "html") -> DataFrame:
    """Watch events of an activity export in HTML (a page a row): one for each cell with a video link and a time."""
    link = F.lit(r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    # steps of one expression, so that each pattern is matched once: a filter on what a pattern gives would be pushed below and match it again
    cells = F.slice(F.split(F.col(html), r'<div[^>]*class="[^"]*outer-cell'), 2, 1_000_000_000)
    cells = F.filter(cells, lambda c: F.regexp_extract(c, r'mdl-typography--title[^>]*>(.*?)</p>', 1).contains("YouTube"))
    bodies = F.transform(cells, lambda c: F.regexp_extract(c, r'(?s)class="(?![^"]*text-right)[^"]*mdl-typography--body-1[^"]*"[^>]*>(.*?)</div>', 1))
    time = lambda b: F.regexp_extract(b, r"(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+JST)", 1)
    found = F.transform(bodies, lambda b: F.struct(F.regexp_extract_all(b, link).alias("hrefs"), F.regexp_extract_all(b, link, F.lit(2)).alias("texts"), time(b).alias("time")))
    # a file of few bytes can hold many pages, so they are dealt to tasks by number
    tasks = pages.sparkSession.sparkContext.defaultParallelism * 4
    rows = pages.select(html).repartition(tasks).select(F.inline(found))
    get = lambda c, i: F.nullif(F.trim(F.get(F.col(c), F.lit(i))), F.lit(""))
    rows = rows.select(get("hrefs", 0).alias("url"), get("texts", 0).alias("title"), get("hrefs", 1).alias("channel_url"), get("texts", 1).alias("channel_name"), exported_time(F.col("time")).alias("at"))
    found = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    token = "([a-zA-Z0-9_-]{11})"
    rows = rows.withColumn("video_id", F.coalesce(found(f"[?&]v={token}"), found(f"/shorts/{token}"), found(rf"youtu\.be/{token}"))).where("video_id IS NOT NULL AND at IS NOT NULL")
    name = F.concat_ws(":", F.lit("google_takeout"), "video_id", F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    return rows.select(
        F.concat(F.lit(EVENT_PREFIX), uuid5(name)).alias("watch_event_id"), F.col("at").alias("watched_at_utc"), "video_id",
        F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("video_url"), F.col("title").alias("video_title"),
        F.nullif(F.regexp_extract("channel_url", "/channel/([a-zA-Z0-9_-]+)", 1), F.lit("")).alias("channel_id"), "channel_name",
        F.when(F.col("url").contains("/shorts/"), "short").otherwise("video").alias("content_type"), F.lit("google_takeout").alias("source"),
        F.col("video_id").alias("source_event_id"), F.lit("google_takeout").alias("source_device"), ingested_at.alias("ingested_at_utc"),
    )
