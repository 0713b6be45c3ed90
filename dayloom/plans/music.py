"""Queries over plays: rankings, statistics, search and the enriched view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.times import in_order, period, within_days
from dayloom.functions.values import first_element, holds

MS_PER_MINUTE = 60_000.0


def top_tracks(plays: DataFrame, start: str, end: str, limit: int = 10) -> DataFrame:
    """The most played tracks of the days from ``start`` to ``end``; ties by track and artist."""
    rows = plays.where(within_days(F.col("played_at_utc"), start, end))
    per = rows.groupBy("track_name", first_element(F.col("artist_names")).alias("artist"))
    found = per.agg(F.count(F.lit(1)).alias("play_count"), (F.sum("ms_played") / F.lit(MS_PER_MINUTE)).alias("total_minutes"))
    return found.orderBy(F.desc("play_count"), F.asc_nulls_last("track_name"), F.asc_nulls_last("artist")).limit(limit)


def listening_stats(plays: DataFrame, start: str, end: str, granularity: str) -> DataFrame:
    """Time listened, plays and distinct tracks of each day, ISO week or month."""
    rows = plays.where(within_days(F.col("played_at_utc"), start, end))
    found = rows.groupBy(period(F.col("played_at_utc"), granularity).alias("period")).agg(
        F.sum("ms_played").alias("total_ms"), F.count(F.lit(1)).alias("track_count"), F.count_distinct("track_id").alias("unique_tracks")
    )
    return in_order(found)


def search_tracks(plays: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Tracks of all time whose name or first artist contains the text, ignoring case."""
    artist = first_element(F.col("artist_names"))
    rows = plays.where(holds(F.col("track_name"), text) | holds(artist, text))
    found = rows.groupBy("track_name", artist.alias("artist")).agg(F.count(F.lit(1)).alias("play_count"), F.max("played_at_utc").cast("string").alias("last_played"))
    return found.orderBy(F.desc("play_count"), F.asc_nulls_last("track_name"), F.asc_nulls_last("artist")).limit(limit)


def plays_enriched(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Plays with what the masters know of the track and its first artist."""
    t = tracks.select("track_id", "duration_ms", F.col("popularity").alias("track_popularity"), F.col("explicit").alias("_explicit"), "preview_url")
    a = artists.select(F.col("artist_id").alias("primary_artist_id"), F.col("name").alias("primary_artist_name"), "genres", F.col("popularity").alias("artist_popularity"), "followers_total")
    rows = plays.join(t, "track_id", "left").join(a, first_element(plays["artist_ids"]) == a["primary_artist_id"], "left")
    return rows.select(
        "play_id", "played_at_utc", "track_id", "track_name", "artist_ids", "artist_names", "album_id", "album_name", "ms_played", "context_type",
        F.col("popularity").alias("play_popularity"), "duration_ms", "track_popularity", F.col("_explicit").alias("explicit"), "preview_url",
        "primary_artist_id", "primary_artist_name", "genres", "artist_popularity", "followers_total",
    )


def loader_stats(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: plays, tracks and the latest play as an instant."""
    p = plays.agg(F.count(F.lit(1)).alias("total_plays"), F.max("played_at_utc").cast("timestamp").alias("latest_play"))
    return p.join(tracks.agg(F.count(F.lit(1)).alias("total_tracks"))).select("total_plays", "total_tracks", "latest_play")  # a row each
