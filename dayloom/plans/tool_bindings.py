"""The tools and jobs bound to the driver tables: rows are landed in a lake of their own and come back through the tool registry or the job.

Each tool must give what the catalogue query behind it gives on the plain table, so it shares that query's SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.operators import jobs, visits
from dayloom.plans.tools import build_registry
from dayloom.sources import service, sinks
from dayloom.sources.catalog import DATASETS, Lake, conform
from dayloom.sources.scratch import shared_dir
from dayloom.sources.tables import table
from dayloom.streaming import page_views, streams

Frames = Callable[[SparkSession, str], dict[str, DataFrame]]


@dataclass(frozen=True)
class ToolCase:
    """A tool with what is landed for it, its parameters, the catalogue query whose SQL it shares and how its columns are shown."""

    tool: str
    land: Frames
    like: str
    given: dict[str, Any]
    shown: Callable[[], dict[str, Column]] = dict  # made when it runs: columns need a session


def landed(spark: SparkSession, frames: dict[str, DataFrame]) -> Lake:
    """A lake with these rows in the raw layer; masters that are snapshots are merged."""
    lake = Lake(spark, shared_dir(spark))
    for name, rows in frames.items():
        dataset = DATASETS[name]
        if dataset.time or dataset.filed_by:
            sinks.append_events(conform(rows, dataset.schema), lake, name)
        else:
            sinks.upsert_master(rows, lake, name)
    return lake


def run(case: ToolCase, spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The tool's rows with the columns that its catalogue query shows."""
    lake = landed(spark, case.land(spark, folder))
    found, shown = build_registry(lake, "raw").execute(case.tool, **case.given), case.shown()
    return found.select(*[shown.get(c, F.col(c)).alias(c) for c in columns])


def plain(column: str) -> Column:
    """A time as the driver tables have it: without a zone."""
    return F.col(column).cast("timestamp_ntz")


# ---- jobs ------------------------------------------------------------------------------------------------------


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """events as payloads of visits, one for each user and day; every seventh user's name a browser that nobody knows."""
    e = table(spark, folder, "events")
    second = F.date_trunc("minute", "ts")  # visits within a minute are at one time, so some fall together
    visit = F.struct(F.concat(F.lit("https://h.example/"), "event_type").alias("url"), F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("visit_time"), F.col("event_type").alias("title"), F.col("event_id").cast("string").alias("visit_id"), F.lit("link").alias("transition"))
    day = F.date_format("ts", "yyyy-MM-dd")
    items = e.groupBy("user_id", day.alias("day")).agg(F.sort_array(F.collect_list(visit)).alias("items"))
    payload = F.struct(
        F.concat_ws("-", "user_id", "day").alias("sync_id"), F.concat(F.lit("d"), "user_id").alias("source_device"), F.when(F.col("user_id") % 7 == 0, "nobody").otherwise("chrome").alias("browser"),
        F.lit("p").alias("profile"), F.concat("day", F.lit("T23:59:59Z")).alias("synced_at"), "items",
    )
    return items.select(F.to_json(payload).alias("value"))


def page_views_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads land as page views, those that are not valid come back; visits of one minute are one view."""
    lake = Lake(spark, shared_dir(spark))
    bad = jobs.ingest_visits(payloads(spark, folder), lake, F.lit("2024-03-01").cast("timestamp"))
    views = lake.scan("browser_history/page_views", layer="raw")
    found = views.groupBy("url").agg(F.count(F.lit(1)).alias("views"), F.sum("visit_span_count").alias("visits"), F.count_distinct("page_view_id").alias("ids"), F.count_distinct("sync_id").alias("syncs"))
    return found.unionByName(bad.agg(F.lit("rejected").alias("url"), F.count(F.lit(1)).alias("views"), *[F.lit(0).cast("long").alias(c) for c in ("visits", "ids", "syncs")]))


def page_views_transformed(spark: SparkSession, folder: str) -> DataFrame:
    """The views themselves, across payloads of one device."""
    good, _ = visits.parse_payloads(payloads(spark, folder))
    found = visits.page_views(visits.visits(good), F.lit("2024-03-01").cast("timestamp"), per_payload=False)
    return found.select("source_device", "url", plain("started_at_utc").alias("started_at"), plain("ended_at_utc").alias("ended_at"), "visit_span_count", "title", "transition")


def page_views_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads in three micro-batches, dealt at random: views are corrected where they were landed, and come out as if all had come at once."""
    base = shared_dir(spark)
    lake = Lake(spark, f"{base}/lake")
    payloads(spark, folder).repartition(24, "value").write.text(f"{base}/in")  # small tables fill fewer files
    stream, work = page_views.page_view_stream(page_views.payload_files(spark, f"{base}/in", 8), lake, F.lit("2024-03-01").cast("timestamp"), "60 days")
    streams.run_available(stream, f"{base}/checkpoint", work, "update")
    found = lake.scan("browser_history/page_views")
    return found.select("source_device", "url", plain("started_at_utc").alias("started_at"), plain("ended_at_utc").alias("ended_at"), "visit_span_count", "title", "transition")


def syncs_overwritten(spark: SparkSession, folder: str) -> DataFrame:
    """Every event lands with its sync, and the syncs of some users once more with less: what an earlier try wrote is replaced, the others stay."""
    lake = Lake(spark, shared_dir(spark))
    e = table(spark, folder, "events")
    rows = e.select(F.col("event_id").cast("string").alias("watch_event_id"), F.col("ts").alias("watched_at_utc"), F.col("event_type").alias("video_id"), (F.col("user_id") % 5).cast("string").alias("browser_history_sync_id"))
    once = conform(rows, DATASETS["youtube/watch_events"].schema)
    sinks.overwrite_sync(once, lake, "youtube/watch_events", "browser_history_sync_id")
    sinks.overwrite_sync(once.where("browser_history_sync_id IN ('1', '3') AND video_id = 'click'"), lake, "youtube/watch_events", "browser_history_sync_id")
    return lake.scan("youtube/watch_events", layer="raw").groupBy(F.col("browser_history_sync_id").alias("sync"), "video_id").agg(F.count(F.lit(1)).alias("n"))


def masters_looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """Plays land, and their tracks and artists are looked up in batches and land once; the second time nothing is missing."""
    p = table(spark, folder, "part")
    plays = p.select(
        F.col("p_partkey").cast("string").alias("play_id"), F.lit("2024-01-01T00:00:00Z").alias("played_at_utc"), F.col("p_partkey").cast("string").alias("track_id"),
        F.array(F.concat(F.lit("a"), "p_size")).alias("artist_ids"),
    )
    lake = landed(spark, {"spotify/plays": plays})
    tracks = lambda ids: [{"id": i, "name": f"T{i}", "artists": [], "duration_ms": int(i) * 2} for i in ids]
    artists = lambda ids: [{"id": i, "name": f"N{i}", "genres": ["g"]} if i != "a7" else None for i in ids]
    for _ in range(2):
        jobs.enrich_masters(lake, tracks, artists, F.lit("2024-02-01").cast("timestamp"))
    t = lake.scan("spotify/tracks", layer="raw").select(F.lit("track").alias("kind"), F.col("track_id").alias("id"), "name", F.col("duration_ms").alias("length"))
    a = lake.scan("spotify/artists", layer="raw").select(F.lit("artist").alias("kind"), F.col("artist_id").alias("id"), "name", F.lit(None).cast("long").alias("length"))
    return t.unionByName(a)


def events_enriched_by_masters(spark: SparkSession, folder: str) -> DataFrame:
    """Watch events with what looked-up videos know; a title that is empty there stays the event's."""
    x, p = table(spark, folder, "lineitem"), table(spark, folder, "part")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    events = x.select(key.alias("watch_event_id"), F.col("l_shipdate").alias("watched_at_utc"), F.col("l_partkey").cast("string").alias("video_id"), F.col("l_returnflag").alias("video_title"), F.lit("video").alias("content_type"))
    lake = landed(spark, {"youtube/watch_events": events})
    videos = p.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("video_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.col("p_brand").alias("channel_id"), F.lit("").alias("channel_name"))
    channels = p.select(F.col("p_brand").alias("channel_id"), F.col("p_brand").alias("channel_name")).distinct()
    found = jobs.enrich_watch_events(lake, videos, channels)
    return found.groupBy("video_id", "video_title", "channel_id").agg(F.count(F.lit(1)).alias("events"))


def _served(spark: SparkSession, folder: str) -> dict[str, str]:
    service.register(spark)
    return {"service": "dayloom.sources.service:TableService", "path": f"{folder}/events.parquet", "time": "ts", "id": "event_id"}


def _item() -> Column:
    return F.from_json("json", "event_id long, event_type string, user_id long, ts string")


def service_by_offset(spark: SparkSession, folder: str) -> DataFrame:
    """All items of a service that answers in pages, by tasks with ranges of offsets."""
    df = spark.read.format(service.NAME).options(**_served(spark, folder), part="200000").load().select(_item().alias("i")).select("i.*")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("total"))


def service_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """What a service has that is new, as a stream whose offset is the cursor, landed once."""
    base = shared_dir(spark)
    stream = spark.readStream.format(service.NAME).options(**_served(spark, folder)).load()
    write = streams.once_per_batch(lambda batch, number: batch.write.mode("append").parquet(f"{base}/rows"), f"{base}/ledger")
    for _ in range(2):
        streams.run_available(stream, f"{base}/checkpoint", write)
    rows = spark.read.parquet(f"{base}/rows").select(_item().alias("i")).select("i.*")
    return rows.groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


_VISITS = """v AS (SELECT user_id, event_type, date_trunc('minute', ts) AS t, CAST(ts AS DATE) AS day FROM events)"""
_TRANSFORMED = f"""WITH {_VISITS} SELECT 'd' || user_id AS source_device, 'https://h.example/' || event_type AS url, t AS started_at, t AS ended_at, count(*) AS visit_span_count, event_type AS title, 'link' AS transition
        FROM v WHERE user_id % 7 > 0 GROUP BY user_id, event_type, t"""
SQL = {
    page_views_ingested: f"""WITH {_VISITS}, g AS (SELECT user_id, event_type, day, t, count(*) AS n FROM v WHERE user_id % 7 > 0 GROUP BY ALL)
        SELECT 'https://h.example/' || event_type AS url, count(*) AS views, CAST(sum(n) AS BIGINT) AS visits, count(*) AS ids, count(DISTINCT (user_id, day)) AS syncs FROM g GROUP BY 1
        UNION ALL SELECT 'rejected', count(DISTINCT (user_id, day)), 0, 0, 0 FROM v WHERE user_id % 7 = 0""",
    page_views_transformed: _TRANSFORMED,
    page_views_streamed: _TRANSFORMED,
    syncs_overwritten: """SELECT CAST(user_id % 5 AS VARCHAR) AS sync, event_type AS video_id, count(*) AS n FROM events e
        WHERE user_id % 5 NOT IN (1, 3) OR event_type = 'click' OR NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'click' AND f.user_id % 5 = e.user_id % 5 AND date_trunc('month', f.ts) = date_trunc('month', e.ts)) GROUP BY ALL""",
    masters_looked_up: """SELECT 'track' AS kind, CAST(p_partkey AS VARCHAR) AS id, 'T' || p_partkey AS name, p_partkey * 2 AS length FROM part
        UNION ALL SELECT DISTINCT 'artist', 'a' || p_size, 'Na' || p_size, CAST(NULL AS BIGINT) FROM part WHERE p_size <> 7""",
    events_enriched_by_masters: """SELECT CAST(l_partkey AS VARCHAR) AS video_id, CASE WHEN p_size > 10 AND p_size % 2 = 0 THEN p_name ELSE l_returnflag END AS video_title,
        CASE WHEN p_size > 10 THEN p_brand END AS channel_id, count(*) AS events FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    service_by_offset: "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1",
    service_streamed: "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
