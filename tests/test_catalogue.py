"""The catalogue on small frames with known results, and on edge cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dayloom.plans import code, music, video, web
from dayloom.sources.catalog import conform, empty
from dayloom.sources.schemas import CHANNELS, COMMITS, PAGE_VIEWS, PLAYS, PULL_REQUESTS, VIDEOS, WATCH_EVENTS

T = datetime.fromisoformat


@pytest.fixture(scope="module")
def plays(spark):
    rows = [
        (T("2024-01-01 10:00"), "track_1", "Song A", ["Artist X"], 180000),
        (T("2024-01-01 11:00"), "track_2", "Song B", ["Artist Y"], 200000),
        (T("2024-01-02 10:00"), "track_1", "Song A", ["Artist X"], 180000),
        (T("2024-01-02 11:00"), "track_3", "Song C", ["Artist Z"], 150000),
        (T("2024-01-03 10:00"), "track_1", "Song A", ["Artist X"], 180000),
    ]
    return conform(spark.createDataFrame(rows, "played_at_utc timestamp_ntz, track_id string, track_name string, artist_names array<string>, ms_played bigint"), PLAYS)


def as_tuples(df):
    return [tuple(r) for r in df.collect()]


def test_top_tracks(plays):
    first = music.top_tracks(plays, "2024-01-01", "2024-01-03").first()
    assert (first["track_name"], first["artist"], first["play_count"], first["total_minutes"]) == ("Song A", "Artist X", 3, 9.0)
    assert dict(music.top_tracks(plays, "2024-01-01", "2024-01-03").dtypes)["total_minutes"] == "double"


def test_listening_stats(plays):
    day = as_tuples(music.listening_stats(plays, "2024-01-01", "2024-01-03", "day"))
    assert day == [("2024-01-01", 380000, 2, 2), ("2024-01-02", 330000, 2, 2), ("2024-01-03", 180000, 1, 1)]
    assert as_tuples(music.listening_stats(plays, "2024-01-01", "2024-01-03", "month")) == [("2024-01", 890000, 5, 3)]
    assert as_tuples(music.listening_stats(plays, "2024-01-01", "2024-01-03", "week"))[0][0] == "2024-W01"
    with pytest.raises(ValueError, match="invalid_granularity"):
        music.listening_stats(plays, "2024-01-01", "2024-01-03", "year")


def test_search_ignores_case_and_keeps_backslash(spark, plays):
    assert as_tuples(music.search_tracks(plays, "song a")) == as_tuples(music.search_tracks(plays, "SONG A"))
    assert music.search_tracks(plays, "artist y").first()["track_name"] == "Song B"
    odd = conform(spark.createDataFrame([("a_b\\c%",), ("axbc",)], "track_name string"), PLAYS)
    assert as_tuples(music.search_tracks(odd, "\\c"))[0][0] == "a_b\\c%"
    assert music.search_tracks(odd, "a_b").count() == 2  # an underscore is a wildcard


def test_empty_and_null_artists_group_together(spark):
    rows = spark.createDataFrame([(T("2024-01-01"), "S", []), (T("2024-01-01"), "S", None)], "played_at_utc timestamp_ntz, track_name string, artist_names array<string>")
    assert [(r["artist"], r["play_count"]) for r in music.top_tracks(conform(rows, PLAYS), "2024-01-01", "2024-01-01").collect()] == [(None, 2)]


@pytest.fixture(scope="module")
def views(spark):
    rows = [
        ("pv_1", T("2026-03-20 10:00"), "https://github.com/owner/repo/pull/79", "edge", "Default"),
        ("pv_2", T("2026-03-20 10:05"), "https://github.com/owner/repo/pulls", "edge", "Default"),
        ("pv_3", T("2026-03-21 08:00"), "https://docs.python.org/3/library/pathlib.html", "edge", "Work"),
        ("pv_4", T("2026-03-21 08:10"), "https://github.com/owner/repo/issues/80", "brave", "Default"),
        ("pv_5", T("2026-03-22 12:00"), "https://news.ycombinator.com/item?id=1", "edge", "Default"),
        ("pv_6", T("2026-04-22 12:00"), "no scheme", "edge", "Default"),
        ("pv_7", T("2026-04-22 12:00"), "http://user@h.com:80/x", "edge", "Default"),
    ]
    return conform(spark.createDataFrame(rows, "page_view_id string, started_at_utc timestamp, url string, browser string, profile string"), PAGE_VIEWS)


def test_page_views(views):
    ids = lambda df: [r["page_view_id"] for r in df.collect()]
    assert ids(web.page_views(views, "2026-03-20", "2026-03-22", limit=3)) == ["pv_5", "pv_4", "pv_3"]
    assert ids(web.page_views(views, "2026-03-20", "2026-03-22", "edge", "Default")) == ["pv_5", "pv_2", "pv_1"]


def test_top_domains(views):
    assert as_tuples(web.top_domains(views, "2026-03-20", "2026-03-22")) == [("github.com", 3, 3), ("docs.python.org", 1, 1), ("news.ycombinator.com", 1, 1)]
    assert as_tuples(web.top_domains(views, "2026-04-01", "2026-04-30")) == [("user@h.com:80", 1, 1)]


@pytest.fixture(scope="module")
def worklog(spark):
    pr = [
        ("pr_event_1", "pr_key_1", "o", "r", "o/r", "opened", T("2024-01-01"), 100, 20),
        ("pr_event_2", "pr_key_1", "o", "r", "o/r", "merged", T("2024-01-02"), 150, 30),
        ("pr_event_3", "pr_key_2", "o", "r", "o/r", "opened", T("2024-01-02"), 50, 10),
    ]
    commits = [("c1", "o", "r", "o/r", T("2024-01-01 10:00"), 100, 20), ("c2", "o", "r", "o/r", T("2024-01-02 10:00"), 50, 10), ("c3", "o", "r", "o/r", T("2024-01-03 10:00"), 10, 5)]
    p = spark.createDataFrame(pr, "pr_event_id string, pr_key string, owner string, repo string, repo_full_name string, action string, updated_at_utc timestamp_ntz, additions bigint, deletions bigint")
    c = spark.createDataFrame(commits, "commit_event_id string, owner string, repo string, repo_full_name string, committed_at_utc timestamp_ntz, additions bigint, deletions bigint")
    return conform(p, PULL_REQUESTS), conform(c, COMMITS)


def test_activity_stats(worklog):
    found = as_tuples(code.activity_stats(*worklog, "2024-01-01", "2024-01-03", "day"))
    assert found == [("2024-01-01", 1, 0, 1, 100, 20), ("2024-01-02", 1, 1, 1, 200, 40), ("2024-01-03", 0, 0, 1, 10, 5)]


def test_repo_summary(worklog):
    (row,) = code.repo_summary(*worklog, "2024-01-01", "2024-01-03").collect()
    assert tuple(row)[3:8] == (2, 1, 3, 310, 65)
    assert row["last_pr_updated_at"] is None and row["last_commit_at"] == T("2024-01-03 10:00")
    assert code.repo_summary(*worklog, "2024-01-01", "2024-01-03", owner="x").count() == 0


def test_repo_summary_fans_out_and_keeps_null_keys(worklog):
    p, c = worklog
    renamed = c.withColumn("repo_full_name", F.concat("repo_full_name", F.when(F.col("commit_event_id") == "c1", "-old").otherwise("")))
    assert code.repo_summary(p, renamed, "2024-01-01", "2024-01-03").count() == 2
    nulls = c.withColumn("owner", F.lit(None).cast("string"))
    assert code.repo_summary(p.withColumn("owner", F.lit(None).cast("string")), nulls, "2024-01-01", "2024-01-03").count() == 2


@pytest.fixture(scope="module")
def watched(spark):
    rows = [(f"e{i}", T(at), v, f"t{v}", None, None, kind) for i, (at, v, kind) in enumerate([("2024-01-01", "video_1", "video"), ("2024-01-02", "video_1", "video"), ("2024-01-03", "video_1", "video"), ("2024-01-01", "video_2", "video"), ("2024-01-02", "video_3", "short")])]
    e = spark.createDataFrame(rows, "watch_event_id string, watched_at_utc timestamp, video_id string, video_title string, channel_id string, channel_name string, content_type string")
    v = spark.createDataFrame([("video_1", "V1", "channel_1", "old"), ("video_2", "V2", "channel_2", "C2")], "video_id string, title string, channel_id string, channel_name string")
    c = spark.createDataFrame([("channel_1", "C1")], "channel_id string, channel_name string")
    return conform(e, WATCH_EVENTS), conform(v, VIDEOS), conform(c, CHANNELS)


def test_watching(watched):
    rows = video.enriched(*watched, "2024-01-01", "2024-01-31")
    assert [r[:2] for r in as_tuples(video.watching_stats(rows, "day"))] == [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 1)]
    assert as_tuples(video.watching_stats(rows, "month"))[0][1] == 5
    assert as_tuples(video.top_videos(rows))[0] == ("video_1", "V1", "channel_1", "C1", 3)
    assert as_tuples(video.top_channels(rows))[0] == ("channel_1", "C1", 3, 1)
    assert video.watch_events(rows, 2).count() == 2


def test_missing_masters_leave_no_join(spark, watched):
    rows = video.enriched(watched[0], empty(spark, VIDEOS), empty(spark, CHANNELS), "2024-01-01", "2024-01-31")
    assert video.watch_events(rows).count() == 5
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_date_filters_reach_the_scan(spark, plays, tmp_path):
    plays.write.parquet(str(tmp_path / "p"))
    plan = music.top_tracks(spark.read.parquet(str(tmp_path / "p")), "2024-01-01", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(played_at_utc" in plan and "album_id" not in plan.split("ReadSchema")[-1]


def test_intermediate_folders_are_cleared(spark):
    from dayloom.sources import files, scratch

    with scratch.cleared(spark):
        path = scratch.shared_dir(spark)
        spark.range(3).write.parquet(path)
    assert not files.exists(spark, path)


def test_a_group_without_a_transition_is_no_row(spark, tmp_path):
    from dayloom.plans.bindings import QUERIES

    rows = [(11, 1, "a"), (23, 1, "a"), (1, 2, "a"), (11, 2, "a"), (9, 3, "b"), (10, 3, "b")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, QUERIES["transition_pick"](spark, str(tmp_path)).collect())) == [(2, "a", "link"), (3, "b", "other_a")]


def test_an_export_of_few_bytes_is_read_by_several_tasks(spark, tmp_path):
    from dayloom.operators import watching

    cell = '<div class="outer-cell"><p class="mdl-typography--title">YouTube</p><div class="mdl-typography--body-1"><a href="https://youtu.be/abcdefghijk">t</a><br>2024/05/06 07:08:09 JST<br></div></div>'
    spark.createDataFrame([(cell * 2,)] * 400, "html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    found = watching.exported_events(spark.read.parquet(str(tmp_path / "pages")), F.lit("2024-06-01").cast("timestamp"))
    rows = found.select("video_id", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 800 and len({r["task"] for r in rows}) > 4
