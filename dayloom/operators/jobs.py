"""Jobs: chains of the operators from payloads to compacted datasets. Every step can be repeated without harm."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dayloom.operators import dedup, listening, visits, watching, worklog
from dayloom.operators.cursors import Cursor, run_all
from dayloom.sources import files, key_filters, sinks
from dayloom.sources.catalog import DATASETS, Lake, conform
from dayloom.sources.paged import by_window, in_batches, lookup

TASK_ROWS = 500_000  # fetched rows for each task that lands them

Fetch = Callable[[list[str]], list[dict | None]]


def ingest_visits(raw: DataFrame, lake: Lake, ingested_at: Column, per_payload: bool = True) -> DataFrame:
    """Land the page views of JSON payloads; rejected payloads come back."""
    good, bad = visits.parse_payloads(raw)
    sinks.append_events(visits.page_views(visits.visits(good), ingested_at, per_payload), lake, "browser_history/page_views")
    return bad


def ingest_compact_derive(raw: DataFrame, lake: Lake, ingested_at: Column) -> dict[str, object]:
    """The chain behind a push of visits: land page views, compact the months that they touch, derive the watch events of their syncs.

    Returns the months, how many payloads were rejected, and for each sync whether its events were derived now. Payloads are read once. Syncs are derived one by
    one and those that fail are named at the end; a repeat lands the views again, which compaction folds, and derives only what is missing.
    """
    name = "browser_history/page_views"
    with staged(raw.select("value"), lake) as held:
        good, bad = visits.parse_payloads(held)
        rejected = bad.count()
        with staged(sinks.with_months(visits.page_views(visits.visits(good), ingested_at), "started_at_utc"), lake) as views:
            months = sorted({(r["year"], r["month"]) for r in views.select("year", "month").distinct().collect()})
            syncs = sorted(r["sync_id"] for r in views.select("sync_id").distinct().collect())  # one for each payload of a push
            sinks.append_events(views.drop("year", "month"), lake, name)
    sinks.compact(lake, name, months)
    derived = run_all({sync: (lambda sync=sync: derive_watch_events(lake, sync)) for sync in syncs})
    return {"months": months, "rejected": rejected, "derived": derived}


def derive_watch_events(lake: Lake, sync_id: str) -> bool:
    """Write the watch events of one sync from compacted page views; False if that has been done before."""
    marker = f"{lake.root}/state/youtube/browser_history_syncs/{sync_id}"
    if files.exists(lake.spark, marker):
        return False
    views = lake.scan("browser_history/page_views").where(F.col("sync_id") == sync_id)
    sinks.overwrite_sync(watching.watch_events(views), lake, "youtube/watch_events", "browser_history_sync_id")
    lake.spark.createDataFrame([(sync_id,)], "sync_id string").coalesce(1).write.json(marker)
    return True


@contextmanager
def staged(rows: DataFrame, lake: Lake) -> Iterator[DataFrame]:
    """Rows written to the lake and read back, so that a live source is read once: what is landed is what moves the cursor. Deleted at the end."""
    path = f"{lake.root}/_staging/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield lake.spark.read.parquet(path)
    finally:
        files.delete(lake.spark, path)


class Landed(int):
    """How many rows were landed; ``unreadable`` of those fetched have a time that cannot be read and were left out."""

    unreadable = 0

    @classmethod
    def of(cls, rows: int, unreadable: int) -> Landed:
        made = cls(rows)
        made.unreadable = unreadable
        return made


def _land(rows: DataFrame, lake: Lake, name: str, time: str, cursor: Cursor, last: str | None) -> Landed:
    """Land staged rows whose instant is after ``last``; the cursor moves to the latest of them once all are written.

    Rows without a readable instant belong to no month and are left out, on the first run as on later ones, and counted.
    """
    at = F.try_to_timestamp(F.col(time).cast("string"))
    with staged(rows, lake) as held:
        after = at.isNotNull() if last is None else at > F.to_timestamp(F.lit(last))
        found = held.agg(F.max_by(F.col(time).cast("string"), at).alias("m"), F.count_if(after).alias("n"), F.count_if(at.isNull()).alias("unreadable")).first()
        if found["n"]:
            sinks.append_events(held.where(after), lake, name)
            cursor.advance(found["m"])
    return Landed.of(found["n"], found["unreadable"])


def ingest_plays(items: DataFrame, lake: Lake, cursor: Cursor) -> Landed:
    """Land plays after the cursor, by instant; the cursor moves only once all are written. Returns the number of new plays."""
    return _land(listening.plays(items), lake, "spotify/plays", "played_at_utc", cursor, cursor.read())


def enrich_masters(lake: Lake, fetch_tracks: Fetch, fetch_artists: Fetch, now: Column) -> dict[str, int]:
    """Look up the tracks and artists that plays mention and the masters lack, and land them under the current month; a failed request fails the job.

    Returns how many rows were landed of each.
    """
    plays, tracks, artists = (lake.scan(f"spotify/{n}", layer="raw") for n in ("plays", "tracks", "artists"))
    landed = {}
    track_ids, artist_ids = listening.missing_master_ids(plays, tracks, artists)
    for name, ids, column, fetch, schema, shape in (
        ("spotify/tracks", track_ids, "track_id", fetch_tracks, listening.TRACK, listening.tracks),
        ("spotify/artists", artist_ids, "artist_id", fetch_artists, listening.ARTIST_ITEM, listening.artists),
    ):
        found = lookup(ids, column, fetch).select(F.from_json("json", schema).alias("i")).select("i.*")
        with staged(shape(found, now), lake) as held:
            landed[name] = held.count()
            sinks.append_events(held, lake, name)
    return landed


def push_visits(fetch: Callable[[str | None, str, int], list[dict]], send: Callable[[list[dict]], object], cursor: Cursor, until: str, page: int = 10_000, wait: float = 5.0) -> int:
    """Read a browser's visits after the cursor up to ``until`` and send them in batches; the cursor moves to ``until`` after the last. Returns their number."""
    sent = in_batches(by_window(fetch, cursor.read(), until, page), send, wait=wait)
    cursor.advance(until)
    return sent


def land_new(rows: DataFrame, lake: Lake, name: str) -> dict[str, int]:
    """Land the rows whose key is not stored yet; how many were fetched, landed, known already, and left out since their time cannot be read.

    The source is evaluated once, into a staging folder, and counted on the way; of what is stored only files are read that can hold one of the keys.
    Counts of what is landed come from the write itself.
    """
    dataset = DATASETS[name]
    fetched, landed = Observation(), Observation()
    with staged(rows.observe(fetched, F.count(F.lit(1)).alias("n")), lake) as held:
        total = fetched.get["n"]
        # a task that lands rows sorts them by month: as many tasks as rows ask for, not as few as their compressed bytes do
        fresh = key_filters.only_new(lake, name, held).repartition(total // TASK_ROWS + 1, dataset.key)
        readable = F.try_to_timestamp(F.col(dataset.time).cast("string")).isNotNull()
        fresh = fresh.observe(landed, F.count_if(readable).alias("n"), F.count_if(~readable).alias("unreadable"))
        sinks.append_events(fresh, lake, name)
        new, unreadable = landed.get["n"], landed.get["unreadable"]
    key_filters.index(lake, name)
    return {"fetched": total, "new": new, "duplicates": total - new - unreadable, "unreadable": unreadable}


def ingest_worklog(pulls: DataFrame, commits: DataFrame, repos: DataFrame, lake: Lake, login: str, now: Column) -> dict[str, dict[str, int]]:
    """Land pull requests and commits that are not stored yet and merge the repositories; counts for each dataset, unreadable times among them if there are any."""
    parts = {"github/pull_requests": worklog.pull_requests(pulls, login, now), "github/commits": worklog.commits(commits, now)}
    counts = {name: {k: n for k, n in land_new(rows, lake, name).items() if n or k != "unreadable"} for name, rows in parts.items()}
    sinks.upsert_master(conform(worklog.repositories(repos, login, now), lake.scan("github/repositories").schema), lake, "github/repositories")
    return counts


def compact_providers(lake: Lake, providers: list[str] | None = None, months: list[tuple[int, int]] | None = None) -> dict[str, object]:
    """Compact all datasets of some providers (``spotify``, ``github``, ``browser_history`` ...), of all by default, over all months by default; one that is unknown is a ValueError."""
    compacted = [d.name for d in DATASETS.values() if d.key and (d.time or d.filed_by)]
    known = sorted({n.split("/")[0] for n in compacted})
    if unknown := set(providers or ()) - set(known):
        raise ValueError(f"unknown providers: {', '.join(sorted(unknown))}; known are {', '.join(known)}")
    return compact_all(lake, [n for n in compacted if not providers or n.split("/")[0] in providers], months)


def compact_all(lake: Lake, names: list[str], months: list[tuple[int, int]] | None = None) -> dict[str, object]:
    """Compact datasets one by one; errors are gathered and raised at the end. ``months`` None means all there are."""
    return run_all({name: (lambda name=name: sinks.compact(lake, name, months)) for name in names})


def enrich_watch_events(lake: Lake, videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Merge video and channel answers into the masters and return the stored events with what those know.

    A video gets the content type of its events, ``video`` if none says otherwise.
    """
    events = lake.scan("youtube/watch_events", layer="raw")
    kinds = watching.video_ids(events).select("video_id", F.col("content_type").alias("_kind"))
    typed = videos.join(kinds, "video_id", "left").withColumn("content_type", F.coalesce("_kind", F.lit("video"))).drop("_kind")
    sinks.upsert_master(typed, lake, "youtube/videos")
    sinks.upsert_master(channels, lake, "youtube/channels")
    return watching.enrich(events, lake.scan("youtube/videos"))


def ingest_watch_history(items: DataFrame, account: str, lake: Lake, cursor: Cursor, not_before: str | None = None) -> Landed:
    """Land an account's watch history after its cursor (and not before a given time); the cursor moves last. Returns the number of rows."""
    rows = watching.watch_history(items, account)
    if not_before is not None:
        rows = rows.where(F.col("watched_at_utc") > F.lit(not_before).cast("timestamp"))
    return _land(rows, lake, "youtube/watch_history", "watched_at_utc", cursor, cursor.read())


def ingest_accounts(items: dict[str, DataFrame], lake: Lake, not_before: str | None = None) -> dict[str, object]:
    """Land the watch history of several accounts, one after the other, each after its own cursor; accounts that fail are named at the end and the rest are landed."""
    cursor = lambda account: Cursor.of(lake, "google_activity", account)
    return run_all({a: (lambda a=a, rows=rows: ingest_watch_history(rows, a, lake, cursor(a), not_before)) for a, rows in items.items()})


def import_export(pages: DataFrame, lake: Lake, ingested_at: Column, after: str | None = None, before: str | None = None) -> DataFrame:
    """Land the watch events of an export that are not stored yet, from ``after`` on and before ``before``; one row of counts of the export comes back.

    A rerun lands nothing more.
    """
    events = watching.exported_events(pages, ingested_at)
    if after:
        events = events.where(F.col("watched_at_utc") >= F.lit(after).cast("timestamp"))
    if before:
        events = events.where(F.col("watched_at_utc") < F.lit(before).cast("timestamp"))
    once = events.dropDuplicates(["watch_event_id"])
    with staged(dedup.only_new(once, lake.scan("youtube/watch_events", layer="raw"), "watch_event_id"), lake) as fresh:
        sinks.append_events(fresh, lake, "youtube/watch_events")
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("video_id").alias("videos"), F.min("watched_at_utc").alias("first"), F.max("watched_at_utc").alias("last"), F.count_if(F.col("channel_id").isNull()).alias("without_channel"))
