"""Queries over watch events, with titles and channels from the masters where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.times import in_order, period, within_days

DEFAULT_LIMIT = 100_000


def enriched(events: DataFrame, videos: DataFrame, channels: DataFrame, start: str, end: str) -> DataFrame:
    """Events of the days from ``start`` to ``end``. The channel is looked up by the video master's channel, else the event's own."""
    rows = events.where(within_days(F.col("watched_at_utc"), start, end))
    v = videos.select("video_id", F.col("title").alias("v_title"), F.col("channel_id").alias("v_channel"), F.col("channel_name").alias("v_name"))
    c = channels.select(F.col("channel_id").alias("c_channel"), F.col("channel_name").alias("c_name"))
    rows = rows.join(v, "video_id", "left").withColumn("_channel", F.coalesce("v_channel", "channel_id"))
    rows = rows.join(c, F.col("_channel") == F.col("c_channel"), "left")
    return rows.select(
        "watch_event_id", "watched_at_utc", "video_id", "video_url", F.coalesce("v_title", "video_title").alias("video_title"), F.col("_channel").alias("channel_id"),
        F.coalesce("c_name", "v_name", "channel_name").alias("channel_name"), "content_type",
    )


def watch_events(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest of ``enriched`` events."""
    return rows.orderBy(F.desc("watched_at_utc"), F.asc_nulls_last("watch_event_id")).limit(DEFAULT_LIMIT if limit is None else limit)


def watching_stats(rows: DataFrame, granularity: str) -> DataFrame:
    """Events, videos and channels of each day, ISO week or month."""
    found = rows.groupBy(period(F.col("watched_at_utc"), granularity).alias("period")).agg(
        F.count(F.lit(1)).alias("watch_event_count"), F.count_distinct("video_id").alias("unique_video_count"), F.count_distinct("channel_id").alias("unique_channel_count")
    )
    return in_order(found)


def top_videos(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The most watched videos, ties by id."""
    found = rows.groupBy("video_id").agg(*[F.max(c).alias(c) for c in ("video_title", "channel_id", "channel_name")], F.count(F.lit(1)).alias("watch_event_count"))
    return found.orderBy(F.desc("watch_event_count"), F.asc_nulls_last("video_id")).limit(limit)


def top_channels(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The most watched channels; events without one do not count."""
    per = rows.where("channel_id IS NOT NULL").groupBy("channel_id")
    found = per.agg(F.max("channel_name").alias("channel_name"), F.count(F.lit(1)).alias("watch_event_count"), F.count_distinct("video_id").alias("unique_video_count"))
    return found.orderBy(F.desc("watch_event_count"), F.asc_nulls_last("channel_id")).limit(limit)
