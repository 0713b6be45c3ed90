"""Plays, tracks and artists from a music service's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.values import fields_of

#: The fields that are read from the service's answers.
TRACK = "struct<id:string,name:string,artists:array<struct<id:string,name:string>>,album:struct<id:string,name:string>,duration_ms:bigint,popularity:bigint,explicit:boolean,preview_url:string>"
PLAY_ITEM = f"track {TRACK}, played_at string, context struct<type:string,uri:string>"
ARTIST_ITEM = "id string, name string, genres array<string>, popularity bigint, followers struct<total:bigint>"


def plays(items: DataFrame) -> DataFrame:
    """Play rows of recently played items (``PLAY_ITEM``); items without a track go. Where an id cannot be formed a hash of the whole item serves, so that a rerun gives the same."""
    t, at = F.col("track"), F.col("played_at")
    key = F.when((at != "") & (t["id"] != ""), F.concat_ws("_", at, t["id"])).otherwise(F.concat(F.lit("item_"), F.sha2(F.to_json(F.struct("track", "played_at", "context")), 256)))
    return items.where(t.isNotNull()).select(
        key.alias("play_id"), at.alias("played_at_utc"), t["id"].alias("track_id"), F.coalesce(t["name"], F.lit("Unknown")).alias("track_name"),
        fields_of(t["artists"], "id").alias("artist_ids"), fields_of(t["artists"], "name").alias("artist_names"), t["album"]["id"].alias("album_id"),
        t["album"]["name"].alias("album_name"), t["duration_ms"].alias("ms_played"), F.col("context.type").alias("context_type"), t["popularity"].alias("popularity"),
        t["explicit"].alias("explicit"),
    )


def tracks(items: DataFrame, updated_at: Column) -> DataFrame:
    """Track master rows of tracks as columns (fields of ``TRACK``)."""
    return items.select(
        F.col("id").alias("track_id"), "name", fields_of(F.col("artists"), "id").alias("artist_ids"), fields_of(F.col("artists"), "name").alias("artist_names"),
        F.col("album.id").alias("album_id"), F.col("album.name").alias("album_name"), "duration_ms", "popularity", "explicit", "preview_url", updated_at.alias("updated_at"),
    )


def artists(items: DataFrame, updated_at: Column) -> DataFrame:
    """Artist master rows of artists (``ARTIST_ITEM``)."""
    return items.select(
        F.col("id").alias("artist_id"), "name", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), "popularity",
        F.col("followers.total").alias("followers_total"), updated_at.alias("updated_at"),
    )


def missing_master_ids(plays: DataFrame, tracks: DataFrame, artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track ids, artist ids) that plays mention and the masters lack."""
    named = lambda df, c: df.where(F.col(c).isNotNull() & (F.col(c) != "")).distinct()
    t = named(plays.select("track_id"), "track_id").join(tracks.select("track_id"), "track_id", "left_anti")
    a = named(plays.select(F.explode("artist_ids").alias("artist_id")), "artist_id").join(artists.select("artist_id"), "artist_id", "left_anti")
    return t, a
