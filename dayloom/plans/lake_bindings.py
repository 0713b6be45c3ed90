"""Scans, sinks, transforms and jobs of the lake bound to the driver tables: rows are landed in a lake of their own and read back through it."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.times import exported_time, first_parsed, instant, relative_day, WATCHED_AT_FORMATS
from dayloom.functions.urls import quoted
from dayloom.operators import cursors, jobs, listening, watching, worklog
from dayloom.plans import music
from dayloom.plans.tools import build_registry
from dayloom.sources import files, key_filters, sinks
from dayloom.sources.catalog import DATASETS, Lake
from dayloom.sources.scratch import shared_dir
from dayloom.sources.tables import table

YEAR = "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'"


def _plays(spark: SparkSession, folder: str, where: str = YEAR) -> DataFrame:
    """orders of a year as plays: the customer is the track."""
    o = table(spark, folder, "orders").where(where)
    names = F.array(F.col("o_orderpriority"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("play_id"), F.col("o_orderdate").alias("played_at_utc"), F.col("o_custkey").cast("string").alias("track_id"),
        F.concat(F.lit("T"), F.col("o_custkey") % 10).alias("track_name"), names.alias("artist_ids"), names.alias("artist_names"), F.floor("o_totalprice").cast("long").alias("ms_played"),
    )


def _plays_of_one_year(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as plays, moved to one year, so that the whole table lands in twelve months."""
    rows = _plays(spark, folder, "true")
    return rows.withColumn("played_at_utc", F.timestamp_add("MONTH", (1996 - F.year("played_at_utc")) * 12, F.col("played_at_utc")))


def _lake(spark: SparkSession) -> Lake:
    return Lake(spark, shared_dir(spark))


def scan_with_missing_months(spark: SparkSession, folder: str) -> DataFrame:
    lake = _lake(spark)
    sinks.append_events(_plays(spark, folder).where("month(played_at_utc) % 2 = 1"), lake, "spotify/plays")
    found = lake.scan("spotify/plays", "1996-02-10", "1996-07-20", "raw")
    return found.groupBy(F.month("played_at_utc").alias("month")).agg(F.count(F.lit(1)).alias("plays"))


def scan_of_mixed_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the rows without a column, a third with it as doubles."""
    lake, rows = _lake(spark), _plays_of_one_year(spark, folder)
    part = F.col("play_id").cast("long") % 3
    sinks.append_events(rows.where(part == 0).drop("ms_played"), lake, "spotify/plays")
    sinks.append_events(rows.where(part == 1).withColumn("ms_played", F.col("ms_played").cast("double")), lake, "spotify/plays")
    sinks.append_events(rows.where(part == 2), lake, "spotify/plays")
    return lake.scan("spotify/plays", layer="raw").select(F.col("play_id").cast("long").alias("play_id"), "ms_played")


def scan_of_a_mirror(spark: SparkSession, folder: str) -> DataFrame:
    """The mirror has two months, with other names, and the rest comes from the root."""
    far, near = _lake(spark), _lake(spark)
    rows = _plays_of_one_year(spark, folder)
    sinks.append_events(rows, far, "spotify/plays")
    sinks.append_events(rows.where("month(played_at_utc) <= 2").withColumn("track_name", F.lit("mirror")), near, "spotify/plays")
    for lake in (far, near):
        sinks.compact(lake, "spotify/plays")
    found = Lake(spark, far.root, near.root).scan("spotify/plays")
    return found.groupBy(F.month("played_at_utc").alias("month"), (F.col("track_name") == "mirror").alias("from_mirror")).agg(F.count(F.lit(1)).alias("plays"))


def months_listed(spark: SparkSession, folder: str) -> DataFrame:
    lake = _lake(spark)
    sinks.append_events(_plays(spark, folder, "month(o_orderdate) = 3 OR year(o_orderdate) = 1998"), lake, "spotify/plays")
    return spark.createDataFrame(lake.months("spotify/plays"), "year int, month int")


def data_available(spark: SparkSession, folder: str) -> DataFrame:
    lake = _lake(spark)
    sinks.append_events(_plays_of_one_year(spark, folder), lake, "spotify/plays")
    return spark.createDataFrame([(n, lake.available(n, "raw")) for n in ("spotify/plays", "github/commits")], "dataset string, available boolean")


def recompacted_months(spark: SparkSession, folder: str) -> DataFrame:
    """All months land twice; of those only the target months of a day in January are compacted."""
    from datetime import date

    lake = _lake(spark)
    for _ in range(2):
        sinks.append_events(_plays(spark, folder, "true"), lake, "spotify/plays")
    jobs.compact_all(lake, ["spotify/plays"], cursors.target_months(today=date(1997, 1, 15)))
    found = lake.scan("spotify/plays")
    return found.groupBy(F.year("played_at_utc").alias("year"), F.month("played_at_utc").alias("month")).agg(F.count(F.lit(1)).alias("plays"))


def master_landed_and_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks land twice by the month of their update, the second time some with a new name, and the last of each month stays."""
    lake = _lake(spark)
    at = F.timestamp_add("DAY", F.col("p_partkey") % 60, F.lit("2024-01-10").cast("timestamp"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("track_id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("artist_names"), F.col("p_size").cast("long").alias("popularity"), at.alias("updated_at"))
    later = rows.where("popularity % 4 = 0").withColumns({"name": F.concat("name", F.lit("+")), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 MINUTE")})
    for part in (rows, rows, later):
        sinks.append_events(part, lake, "spotify/tracks")
    sinks.compact(lake, "spotify/tracks")
    return lake.scan("spotify/tracks").select("track_id", "name", "popularity", F.array_join("artist_names", " ").alias("artists"))


def master_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots of a master, one after the other; blank ids go."""
    lake = _lake(spark)
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("channel_id"), F.col("s_name").alias("channel_name"), F.col("s_nationkey").cast("long").alias("video_count"))
    sinks.upsert_master(s, lake, "youtube/channels")
    sinks.upsert_master(s.where("video_count % 3 = 0").withColumn("channel_name", F.lit("new")), lake, "youtube/channels")
    sinks.upsert_master(s.limit(1).withColumn("channel_id", F.lit("")), lake, "youtube/channels")
    return lake.scan("youtube/channels").select("channel_id", "channel_name", "video_count")


def views_of_the_lake(spark: SparkSession, folder: str) -> DataFrame:
    """Every dataset's view counted, each with rows of another table landed in it."""
    lake = _lake(spark)
    key = lambda c: F.col(c).cast("string")
    day = lambda c: F.timestamp_add("DAY", F.pmod(c, F.lit(60)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    load = lambda name, c, dataset, time: sinks.append_events(table(spark, folder, name).select(key(c).alias(DATASETS[dataset].key or "watch_id"), day(F.col(c)).alias(time)), lake, dataset)
    load("orders", "o_orderkey", "spotify/plays", "played_at_utc")
    load("part", "p_partkey", "spotify/tracks", "updated_at")
    load("supplier", "s_suppkey", "spotify/artists", "updated_at")
    load("customer", "c_custkey", "github/pull_requests", "updated_at_utc")
    load("lineitem", "l_orderkey", "github/commits", "committed_at_utc")
    load("pages", "page_id", "browser_history/page_views", "started_at_utc")
    load("events", "event_id", "youtube/watch_events", "watched_at_utc")
    load("documents", "doc_id", "youtube/watch_history", "watched_at_utc")
    for name, c, dataset in (("nation", "n_nationkey", "youtube/videos"), ("region", "r_regionkey", "youtube/channels"), ("supplier", "s_suppkey", "github/repositories")):
        sinks.upsert_master(table(spark, folder, name).select(key(c).alias(DATASETS[dataset].key)), lake, dataset)
    names = lake.register_views("raw")
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n FROM {n}" for n in names))


def plays_view(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of plays with their masters."""
    p = table(spark, folder, "part")
    key, first = F.col("p_partkey").cast("string"), F.split("p_name", " ")
    played = p.select(
        key.alias("play_id"), F.timestamp_add("DAY", F.col("p_size"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("played_at_utc"), key.alias("track_id"), F.col("p_name").alias("track_name"), first.alias("artist_ids"),
        first.alias("artist_names"), F.col("p_brand").alias("album_id"), F.col("p_type").alias("album_name"), F.col("p_size").cast("long").alias("ms_played"), F.lit("album").alias("context_type"), (F.col("p_partkey") % 7).alias("popularity"),
    )
    tracks = p.where("p_size > 10").select(key.alias("track_id"), (F.col("p_size") * 2).cast("long").alias("duration_ms"), (F.col("p_partkey") % 5).alias("popularity"), (F.col("p_size") > 20).alias("explicit"), F.col("p_brand").alias("preview_url"))
    artists = p.select(F.get(first, F.lit(0)).alias("artist_id")).distinct().where(F.ascii("artist_id") % 2 == 0)
    artists = artists.select("artist_id", F.upper("artist_id").alias("name"), F.array(F.lit("g"), F.col("artist_id")).alias("genres"), F.ascii("artist_id").cast("long").alias("popularity"), F.length("artist_id").cast("long").alias("followers_total"))
    found = music.plays_enriched(played, tracks, artists)
    return found.withColumns({c: F.array_join(c, "|") for c in ("artist_ids", "artist_names", "genres")})


def tool_top_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """A tool over the compacted layer: repeats of landing do not count."""
    lake = _lake(spark)
    for _ in range(2):
        sinks.append_events(_plays(spark, folder), lake, "spotify/plays")
    sinks.compact(lake, "spotify/plays")
    return build_registry(lake).execute("get_top_tracks", start_date="1996-02-01", end_date="1996-05-15", limit=7).withColumn("total_minutes", F.round("total_minutes", 9))


def tool_listening_of_the_raw_layer(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the raw layer, where they do."""
    lake = _lake(spark)
    for _ in range(2):
        sinks.append_events(_plays(spark, folder), lake, "spotify/plays")
    return build_registry(lake, "raw").execute("get_listening_stats", start_date="1996-02-01", end_date="1996-05-15", granularity="month")


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pull_request_rows(spark: SparkSession, folder: str) -> DataFrame:
    """orders as answers of the code host: every third is another owner's, a fifth of the heads are gone."""
    o = table(spark, folder, "orders")
    day, owner = _day("o_orderdate"), F.when(F.col("o_custkey") % 3 == 0, "you").otherwise("me")
    name = F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string"))
    repo = F.struct(name.alias("name"), F.concat_ws("/", owner, name).alias("full_name"), F.struct(owner.alias("login")).alias("owner"))
    merged = F.when(F.col("o_orderstatus") == "F", day)
    items = o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("number"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.lit("closed")).alias("state"),
        day.alias("created_at"), day.alias("updated_at"), F.lit(None).cast("string").alias("closed_at"), merged.alias("merged_at"),
        F.transform(F.array(F.lit("x"), F.lit(""), F.col("o_orderstatus")), lambda x: F.struct(x.alias("name"))).alias("labels"), F.struct(F.lit("main").alias("ref")).alias("base"),
        F.struct(F.lit("h").alias("ref"), F.when(F.col("o_orderkey") % 5 > 0, repo).alias("repo")).alias("head"),
        *[F.lit(n).cast("long").alias(c) for n, c in enumerate(("comments", "review_comments", "reviews_count", "commits", "additions", "deletions", "changed_files"))],
    )
    found = worklog.pull_requests(items, "me", F.lit("2024-01-01"))
    return found.select("pr_event_id", "pr_key", "repo_full_name", "pr_number", "action", "state", "is_merged", F.array_join("labels", ",").alias("labels"), "base_ref", "merged_at_utc", "additions", "changed_files_count")


def commit_rows(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    sha = F.when(F.col("l_linenumber") == 4, "").otherwise(F.sha1(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")))
    listed = F.when(F.col("l_linenumber") != 2, F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.struct(i.cast("string").alias("filename"))))
    items = x.select(
        F.concat_ws("/", "l_returnflag", (F.col("l_suppkey") % 7).cast("string"), F.lit("z")).alias("repo_full_name"), sha.alias("sha"), F.struct(F.col("l_linestatus").alias("message"), F.struct(_day("l_shipdate").alias("date")).alias("author")).alias("commit"),
        F.struct(F.floor("l_quantity").cast("long").alias("additions"), F.col("l_suppkey").alias("deletions")).alias("stats"), listed.alias("files"),
    )
    return worklog.commits(items, F.lit("2024-01-01")).select("commit_event_id", "owner", "repo", "message", "committed_at_utc", "changed_files_count", "additions", "deletions")


def repository_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    null = F.lit(None).cast("string")
    items = p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.concat_ws("/", F.lit("me"), "p_brand").alias("full_name"), F.struct(F.when(F.col("p_size") % 2 == 0, "me").otherwise("you").alias("login")).alias("owner"),
        F.when(F.col("p_size") > 20, F.col("p_type")).alias("description"), null.alias("homepage"), F.when(F.col("p_size") > 10, F.col("p_size") > 30).alias("private"), F.lit(None).cast("boolean").alias("fork"), F.lit(True).alias("archived"),
        F.lit("main").alias("default_branch"), null.alias("language"), F.when(F.col("p_size") > 5, F.split("p_name", " ")).alias("topics"), F.col("p_size").cast("long").alias("stargazers_count"), F.lit(1).cast("long").alias("forks_count"),
        F.lit(2).cast("long").alias("open_issues_count"), F.lit(3).cast("long").alias("size"), *[null.alias(f"{x}_at") for x in ("created", "updated", "pushed")],
    )
    found = worklog.repositories(items, "me", F.lit("2024-01-01"))
    return found.select("repo_id", "repo", "repo_full_name", "is_private", "is_fork", "archived", F.size("topics").alias("topics"), "stargazers_count", "repo_summary_text")


def _tracks(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    artists = F.transform(F.split("p_name", " "), lambda x: F.struct(F.upper(x).alias("id"), x.alias("name")))
    track = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), artists.alias("artists"), F.struct(F.col("p_brand").alias("id"), F.col("p_type").alias("name")).alias("album"), F.col("p_size").cast("long").alias("duration_ms"), F.lit(1).cast("long").alias("popularity"), F.lit(False).alias("explicit"), F.lit(None).cast("string").alias("preview_url"))
    return p.select("p_partkey", "p_size", track.alias("track"))


def play_rows(spark: SparkSession, folder: str) -> DataFrame:
    """part as recently played items: those of size 1 to 5 have no track."""
    rows = _tracks(spark, folder)
    at = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit("Z"))
    items = rows.select(F.when(F.col("p_size") > 5, F.col("track")).alias("track"), at.alias("played_at"), F.struct(F.lit("album").alias("type"), F.lit("u").alias("uri")).alias("context"))
    return listening.plays(items).select("play_id", "played_at_utc", "track_id", "track_name", F.array_join("artist_ids", "|").alias("artist_ids"), "album_id", "ms_played", "context_type")


def track_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = listening.tracks(_tracks(spark, folder).select("track.*"), F.lit("2024-01-01"))
    return found.select("track_id", "name", F.array_join("artist_names", "|").alias("artist_names"), "album_name", "duration_ms", "updated_at")


def artist_rows(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    items = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") > 5, F.array(F.lit("a"), F.lit("b"))).alias("genres"), F.col("s_nationkey").cast("long").alias("popularity"), F.struct(F.col("s_suppkey").alias("total")).alias("followers"))
    return listening.artists(items, F.lit("2024-01-01")).select("artist_id", "name", F.array_join("genres", "|").alias("genres"), "popularity", "followers_total")


def new_master_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks and artists that plays mention and the masters lack."""
    plays = play_rows(spark, folder).withColumn("artist_ids", F.split("artist_ids", r"\|"))
    known = lambda c: plays.select(F.col(c)).where(F.col(c).cast("long") % 3 == 0)
    t, a = listening.missing_master_ids(plays, known("track_id"), plays.select(F.get("artist_ids", F.lit(0)).alias("artist_id")).distinct())
    return t.select(F.lit("track").alias("kind"), F.col("track_id").alias("id")).unionByName(a.select(F.lit("artist").alias("kind"), F.col("artist_id").alias("id")))


def _thumbnails() -> Column:
    url = lambda test, name: F.when(test, F.struct(F.concat(F.lit(name), F.col("p_brand")).alias("url")))
    return F.struct(url(F.col("p_size") > 30, "h").alias("high"), F.when(F.col("p_size") > 20, F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("m"), F.col("p_brand"))).otherwise("").alias("url"))).alias("medium"), url(F.col("p_size") > 5, "d").alias("default"))


def video_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    s = F.struct(
        F.col("p_name").alias("title"), F.col("p_brand").alias("channelId"), F.col("p_type").alias("channelTitle"), F.lit("2024-01-02T03:04:05Z").alias("publishedAt"), F.lit(None).cast("string").alias("description"), F.lit("1").alias("categoryId"),
        F.split("p_name", " ").alias("tags"), _thumbnails().alias("thumbnails"),
    )
    count = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    items = p.select(F.col("p_partkey").cast("string").alias("id"), s.alias("snippet"), F.struct(F.format_string("PT%dM%dS", F.col("p_size"), F.col("p_partkey") % 60).alias("duration")).alias("contentDetails"), F.struct(count.alias("viewCount"), F.lit("7").alias("likeCount"), F.lit(None).cast("string").alias("commentCount")).alias("statistics"))
    found = watching.videos(items, F.lit("2024-01-01").cast("timestamp"))
    return found.select("video_id", "title", "channel_id", "duration_seconds", "view_count", "like_count", "comment_count", F.col("published_at").cast("string").alias("published_at"), "thumbnail_url", F.size("tags").alias("tags"))


def channel_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    s = F.struct(F.col("p_name").alias("title"), F.lit("then").alias("publishedAt"), F.col("p_type").alias("description"), F.lit("JP").alias("country"), _thumbnails().alias("thumbnails"))
    items = p.select(F.col("p_partkey").cast("string").alias("id"), s.alias("snippet"), F.struct(F.col("p_size").cast("string").alias("subscriberCount"), F.lit("1.5").alias("videoCount"), F.lit("9").alias("viewCount")).alias("statistics"))
    return watching.channels(items, F.lit("2024-01-01").cast("timestamp")).select("channel_id", "channel_name", "subscriber_count", "video_count", "view_count", "published_at", "thumbnail_url", "country")


def watch_history_rows(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "no time").otherwise(_day("o_orderdate"))
    items = x.select(F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("video_id"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("channel_name"), text.alias("watched_at"), F.lit("u").alias("video_url"))
    return watching.watch_history(items, "me").select("watch_id", F.col("watched_at_utc").cast("string").alias("watched_at"), "video_id", "video_title", "channel_name")


def history_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Watch history landed up to a cursor, then the rest: every row once."""
    lake = _lake(spark)
    o = table(spark, folder, "orders")
    items = o.select(F.col("o_orderkey").cast("string").alias("video_id"), F.lit("t").alias("title"), F.lit("c").alias("channel_name"), _day("o_orderdate").alias("watched_at"), F.lit("u").alias("video_url"))
    cursor = cursors.Cursor.of(lake, "google", "me")
    for part in (items.where("watched_at < '1996-05-01'"), items, items):
        jobs.ingest_watch_history(part, "me", lake, cursor, "1996-02-01")
    found = lake.scan("youtube/watch_history", layer="raw")
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("video_id").alias("videos"), F.lit(cursor.read()).alias("cursor"))


def exported_rows(spark: SparkSession, folder: str) -> DataFrame:
    """An export page for each part, of three cells: a video, something else, and a video without a time."""
    p = table(spark, folder, "part")
    video = F.format_string('<a href="https://www.youtube.com/%s%011d">%s</a><a href="https://www.youtube.com/channel/UC%d">%s</a>', F.when(F.col("p_size") % 2 == 0, "watch?v=").otherwise("shorts/"), "p_partkey", "p_name", F.col("p_size"), "p_brand")
    cell = lambda title, at: F.concat(F.lit(f'<div class="outer-cell"><p class="mdl-typography--title">{title}</p><div class="mdl-typography--body-1">'), video, F.lit(f"<br>{at}<br></div></div>"))
    html = F.concat(F.lit("<html>"), cell("YouTube", "2024/05/06 07:08:09 JST"), cell("Maps", "2024/05/06 07:08:09 JST"), cell("YouTube", ""))
    found = watching.exported_events(p.select(html.alias("html")), F.lit("2024-06-01").cast("timestamp"))
    return found.select("video_id", "video_title", "channel_id", "channel_name", "content_type", "video_url", F.col("watched_at_utc").cast("string").alias("watched_at"))


def worklog_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Commits landed in two goes: how many were fetched, new and known the second time."""
    lake = _lake(spark)
    x = table(spark, folder, "lineitem")
    sha = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")
    items = x.select(F.lit("me/r").alias("repo_full_name"), sha.alias("sha"), F.struct(F.lit("m").alias("message"), F.struct(_day("l_shipdate").alias("date")).alias("author")).alias("commit"), F.struct(F.lit(1).cast("long").alias("additions"), F.lit(2).cast("long").alias("deletions")).alias("stats"), F.lit(None).cast("array<struct<filename:string>>").alias("files"))
    pulls, repos = spark.createDataFrame([], worklog.PULL_ITEM), spark.createDataFrame([], worklog.REPO.removeprefix("struct<").removesuffix(">"))
    now = F.lit("2024-01-01")
    jobs.ingest_worklog(pulls, items.where("sha LIKE '%:1:%'"), repos, lake, "me", now)
    counts = jobs.ingest_worklog(pulls, items, repos, lake, "me", now)["github/commits"]
    landed = lake.scan("github/commits", layer="raw").agg(F.count_distinct("commit_event_id").alias("landed"))
    return landed.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("fetched", "new", "duplicates")], "landed")


def only_new_by_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every line as a commit: half are stored in two goes, the second not indexed, and the rest is found to be new."""
    lake = _lake(spark)
    x = table(spark, folder, "lineitem")
    rows = x.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("commit_event_id"), _day("l_shipdate").alias("committed_at_utc"), "l_orderkey")
    for part in (0, 1):
        sinks.append_events(rows.where(F.col("l_orderkey") % 4 == part).drop("l_orderkey"), lake, "github/commits")
        if not part:
            key_filters.index(lake, "github/commits")
    found = key_filters.only_new(lake, "github/commits", rows)
    return found.groupBy((F.col("l_orderkey") % 4).alias("part")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"))


def time_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of times in several forms as instants, and headings of days."""
    o = table(spark, folder, "orders")
    shaped = lambda f: F.date_format("o_orderdate", f)
    kind = F.col("o_orderkey") % 3
    several = F.when(kind == 0, shaped("yyyy-MM-dd HH:mm:ss")).when(kind == 1, shaped("yyyy年MM月dd日 HH:mm")).otherwise("soon")
    heading = F.when(kind == 0, "Today").when(kind == 1, "Yesterday").otherwise(shaped("yyyy/M/d"))
    text = lambda c: c.cast("string")
    return o.select(
        "o_orderkey", text(instant(_day("o_orderdate"))).alias("iso"), text(first_parsed(several, WATCHED_AT_FORMATS)).alias("several"), text(exported_time(F.concat(shaped("yyyy/MM/dd HH:mm:ss"), F.lit(" JST")))).alias("exported"),
        text(relative_day(heading, F.lit("2024-03-01").cast("date"))).alias("day"),
    )


def quoted_names(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select("p_partkey", quoted(F.concat_ws("/", "p_name", "p_type", F.lit("é"))).alias("quoted"))


def raw_json_kept(spark: SparkSession, folder: str) -> DataFrame:
    """An audit copy as JSON lines by day, read back."""
    lake = _lake(spark)
    e = table(spark, folder, "events").select("event_id", "ts", "props")
    sinks.write_raw_json(e, f"{lake.root}/raw", "ts")
    return spark.read.json(f"{lake.root}/raw").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def files_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Which tables have a file, by pattern and by name, and how many rows those hold that the pattern finds."""
    found = {Path(p).name: p for p in files.matches(spark, f"{folder}/p*.parquet")}
    rows = [(n, f"{n}.parquet" in found, files.exists(spark, f"{folder}/{n}.parquet")) for n in ("part", "pages", "orders", "nothing")]
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n.removesuffix(".parquet")).alias("name"), "rows") for n, p in found.items()]
    return spark.createDataFrame(rows, "name string, listed boolean, present boolean").join(reduce(DataFrame.unionByName, counts), "name", "left")


_PLAYS = f"SELECT *, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE {YEAR}"
_ALL_PLAYS = "SELECT *, month(o_orderdate) AS m FROM orders"
_THUMB = "CASE WHEN p_size > 30 THEN 'h' || p_brand WHEN p_size > 20 AND p_size % 2 = 0 THEN 'm' || p_brand WHEN p_size > 5 THEN 'd' || p_brand END"
_TOOL = "o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-05-16'"
_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"
#: Each query with SQL of another shape that gives the same rows.
SQL = {
    scan_with_missing_months: f"SELECT CAST(m AS INTEGER) AS month, count(*) AS plays FROM ({_PLAYS}) WHERE m % 2 = 1 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1996-07-20' GROUP BY m",
    scan_of_mixed_schemas: f"SELECT o_orderkey AS play_id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS ms_played FROM ({_ALL_PLAYS})",
    scan_of_a_mirror: f"SELECT CAST(m AS INTEGER) AS month, m <= 2 AS from_mirror, count(*) AS plays FROM ({_ALL_PLAYS}) GROUP BY m",
    months_listed: "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE month(o_orderdate) = 3 OR year(o_orderdate) = 1998",
    data_available: f"SELECT 'spotify/plays' AS dataset, count(*) > 0 AS available FROM ({_ALL_PLAYS}) UNION ALL SELECT 'github/commits', false",
    recompacted_months: "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS plays FROM orders WHERE o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '1997-02-01' GROUP BY ALL",
    master_landed_and_compacted: "SELECT CAST(p_partkey AS VARCHAR) AS track_id, CASE WHEN p_size % 4 = 0 THEN p_name || '+' ELSE p_name END AS name, CAST(p_size AS BIGINT) AS popularity, p_name AS artists FROM part",
    master_upserts: "SELECT CAST(s_suppkey AS VARCHAR) AS channel_id, CASE WHEN s_nationkey % 3 = 0 THEN 'new' ELSE s_name END AS channel_name, CAST(s_nationkey AS BIGINT) AS video_count FROM supplier",
    views_of_the_lake: "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{view}' AS dataset, count(*) AS n FROM {name}"
        for view, name in (
            ("spotify_plays", "orders"), ("spotify_tracks", "part"), ("spotify_artists", "supplier"), ("github_pull_requests", "customer"), ("github_commits", "lineitem"), ("github_repositories", "supplier"),
            ("browser_history_page_views", "pages"), ("youtube_watch_events", "events"), ("youtube_watch_history", "documents"), ("youtube_videos", "nation"), ("youtube_channels", "region"),
        )
    ) + ")",
    plays_view: """WITH n AS (SELECT *, string_split(p_name, ' ')[1] AS a FROM part) SELECT CAST(p_partkey AS VARCHAR) AS play_id, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) AS played_at_utc, CAST(p_partkey AS VARCHAR) AS track_id, p_name AS track_name,
        replace(p_name, ' ', '|') AS artist_ids, replace(p_name, ' ', '|') AS artist_names, p_brand AS album_id, p_type AS album_name, CAST(p_size AS BIGINT) AS ms_played, 'album' AS context_type, p_partkey % 7 AS play_popularity,
        CASE WHEN p_size > 10 THEN CAST(p_size * 2 AS BIGINT) END AS duration_ms, CASE WHEN p_size > 10 THEN p_partkey % 5 END AS track_popularity, CASE WHEN p_size > 10 THEN p_size > 20 END AS explicit, CASE WHEN p_size > 10 THEN p_brand END AS preview_url,
        CASE WHEN ascii(a) % 2 = 0 THEN a END AS primary_artist_id, CASE WHEN ascii(a) % 2 = 0 THEN upper(a) END AS primary_artist_name, CASE WHEN ascii(a) % 2 = 0 THEN 'g|' || a END AS genres, CASE WHEN ascii(a) % 2 = 0 THEN CAST(ascii(a) AS BIGINT) END AS artist_popularity,
        CASE WHEN ascii(a) % 2 = 0 THEN CAST(length(a) AS BIGINT) END AS followers_total FROM n""",
    tool_top_tracks: f"SELECT 'T' || (o_custkey % 10) AS track_name, o_orderpriority AS artist, count(*) AS play_count, round(sum(CAST(floor(o_totalprice) AS BIGINT)) / 60000.0, 9) AS total_minutes FROM orders WHERE {_TOOL} GROUP BY ALL ORDER BY play_count DESC, track_name, artist LIMIT 7",
    tool_listening_of_the_raw_layer: f"SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(2 * sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_ms, 2 * count(*) AS track_count, count(DISTINCT o_custkey) AS unique_tracks FROM orders WHERE {_TOOL} GROUP BY 1",
    pull_request_rows: f"""WITH o AS (SELECT *, 'me/r' || (o_custkey % 4) AS name, o_orderkey % 100 AS number, {_ISO} AS day, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'closed' END AS state FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 5 > 0)
        SELECT sha256(concat_ws(':', name, number, day, state)) AS pr_event_id, sha256(concat_ws(':', name, number)) AS pr_key, name AS repo_full_name, number AS pr_number, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'P' THEN 'opened' ELSE 'closed' END AS action, state,
        o_orderstatus = 'F' AS is_merged, 'x,' || o_orderstatus AS labels, 'main' AS base_ref, CASE WHEN o_orderstatus = 'F' THEN day END AS merged_at_utc, CAST(4 AS BIGINT) AS additions, CAST(6 AS BIGINT) AS changed_files_count FROM o""",
    commit_rows: """SELECT concat_ws(':', concat_ws('/', l_returnflag, l_suppkey % 7, 'z'), sha1(concat_ws(':', l_orderkey, l_linenumber, l_partkey))) AS commit_event_id, l_returnflag AS owner, (l_suppkey % 7) || '/z' AS repo, l_linestatus AS message,
        strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS committed_at_utc, CASE WHEN l_linenumber <> 2 THEN CAST(l_linenumber AS BIGINT) END AS changed_files_count, CAST(floor(l_quantity) AS BIGINT) AS additions, l_suppkey AS deletions FROM lineitem WHERE l_linenumber <> 4""",
    repository_rows: """WITH r AS (SELECT *, CASE WHEN p_size > 5 THEN string_split(p_name, ' ') ELSE [] END AS topics FROM part WHERE p_size % 2 = 0)
        SELECT p_partkey AS repo_id, p_brand AS repo, 'me/' || p_brand AS repo_full_name, p_size > 30 AS is_private, false AS is_fork, true AS archived, CAST(len(topics) AS INTEGER) AS topics, CAST(p_size AS BIGINT) AS stargazers_count,
        concat_ws(' | ', CASE WHEN p_size > 20 THEN p_type END, CASE WHEN len(topics) > 0 THEN 'Topics: ' || array_to_string(list_slice(topics, 1, 5), ', ') END) AS repo_summary_text FROM r""",
    play_rows: """WITH p AS (SELECT *, '2024-01-01T00:00:' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || 'Z' AS moment FROM part WHERE p_size > 5)
        SELECT moment || '_' || p_partkey AS play_id, moment AS played_at_utc, CAST(p_partkey AS VARCHAR) AS track_id, p_name AS track_name, replace(upper(p_name), ' ', '|') AS artist_ids, p_brand AS album_id, CAST(p_size AS BIGINT) AS ms_played, 'album' AS context_type FROM p""",
    track_rows: "SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_name AS name, replace(p_name, ' ', '|') AS artist_names, p_type AS album_name, CAST(p_size AS BIGINT) AS duration_ms, '2024-01-01' AS updated_at FROM part",
    artist_rows: "SELECT CAST(s_suppkey AS VARCHAR) AS artist_id, s_name AS name, CASE WHEN s_nationkey > 5 THEN 'a|b' ELSE '' END AS genres, CAST(s_nationkey AS BIGINT) AS popularity, s_suppkey AS followers_total FROM supplier",
    new_master_ids: """WITH p AS (SELECT p_partkey, unnest(string_split(upper(p_name), ' ')) AS a, string_split(upper(p_name), ' ')[1] AS first FROM part WHERE p_size > 5)
        SELECT DISTINCT 'track' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM p WHERE p_partkey % 3 > 0 UNION ALL SELECT DISTINCT 'artist', a FROM p WHERE a NOT IN (SELECT first FROM p)""",
    video_rows: f"""SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name AS title, p_brand AS channel_id, CAST(p_size * 60 + p_partkey % 60 AS BIGINT) AS duration_seconds, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS BIGINT) END AS view_count, CAST(7 AS BIGINT) AS like_count,
        CAST(NULL AS BIGINT) AS comment_count, '2024-01-02 03:04:05' AS published_at, {_THUMB} AS thumbnail_url, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS tags FROM part""",
    channel_rows: f"SELECT CAST(p_partkey AS VARCHAR) AS channel_id, p_name AS channel_name, CAST(p_size AS BIGINT) AS subscriber_count, CAST(NULL AS BIGINT) AS video_count, CAST(9 AS BIGINT) AS view_count, CAST(NULL AS TIMESTAMP) AS published_at, {_THUMB} AS thumbnail_url, 'JP' AS country FROM part",
    watch_history_rows: "SELECT substr(sha256(concat('me_v', o_custkey, '_', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '+00:00')), 1, 16) AS watch_id, CAST(o_orderdate AS VARCHAR) AS watched_at, 'v' || o_custkey AS video_id, o_orderpriority AS video_title, o_orderstatus AS channel_name FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0",
    history_ingested: "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS videos, CAST(max(o_orderdate) AS VARCHAR) AS cursor FROM orders WHERE o_orderdate > TIMESTAMP '1996-02-01'",
    exported_rows: """WITH v AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS id FROM part)
        SELECT id AS video_id, p_name AS video_title, 'UC' || p_size AS channel_id, p_brand AS channel_name, CASE WHEN p_size % 2 = 0 THEN 'video' ELSE 'short' END AS content_type, 'https://www.youtube.com/watch?v=' || id AS video_url, '2024-05-05 22:08:09' AS watched_at FROM v""",
    worklog_ingested: "SELECT count(*) AS fetched, count(*) FILTER (WHERE l_linenumber <> 1) AS new, count(*) FILTER (WHERE l_linenumber = 1) AS duplicates, count(DISTINCT concat_ws(':', l_orderkey, l_linenumber, l_partkey)) AS landed FROM lineitem",
    only_new_by_filters: "SELECT l_orderkey % 4 AS part, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey % 4 > 1 GROUP BY 1",
    time_texts: """SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS iso, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS VARCHAR) WHEN 1 THEN CAST(date_trunc('minute', o_orderdate) AS VARCHAR) END AS several, CAST(o_orderdate - INTERVAL 9 HOURS AS VARCHAR) AS exported,
        CASE o_orderkey % 3 WHEN 0 THEN '2024-03-01' WHEN 1 THEN '2024-02-29' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""",
    quoted_names: "SELECT p_partkey, url_encode(concat_ws('/', p_name, p_type, 'é')) AS quoted FROM part",
    raw_json_kept: "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    files_listed: "SELECT * FROM (VALUES ('part', true, true, (SELECT count(*) FROM part)), ('pages', true, true, (SELECT count(*) FROM pages)), ('orders', false, true, NULL), ('nothing', false, false, NULL)) AS t(name, listed, present, rows)",
}
