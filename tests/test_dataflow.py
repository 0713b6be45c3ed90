"""Visits, merging, masters, compaction and jobs on small inputs and edge cases.

Fixed values: the texts and results of the visit, compaction and duration cases are those that the behaviour to be matched is known by.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dayloom.operators import cursors, dedup, jobs, listening, visits, watching, worklog
from dayloom.sources import files, sinks
from dayloom.sources.catalog import DATASETS, Lake, conform
from dayloom.streaming import streams

T = datetime.fromisoformat
def NOW():  # noqa: N802  a column needs a session
    return F.lit("2026-03-20 09:00:00").cast("timestamp")



def payload(items, sync="s1", browser="edge", **more):
    return json.dumps({"sync_id": sync, "source_device": "pc", "browser": browser, "profile": "Default", "synced_at": "2026-03-20T08:40:00Z", "items": items, **more})


def visit(at, url="https://a.example/x", title="A", transition="link"):
    return {"url": url, "visit_time": at, "title": title, "transition": transition}


def views_of(spark, texts, per_payload=True):
    good, bad = visits.parse_payloads(spark.createDataFrame([(t,) for t in texts], "value string"))
    return visits.page_views(visits.visits(good), NOW(), per_payload), bad


def test_visits_cluster(spark):
    rows, bad = views_of(spark, [payload([visit("2026-03-20T08:31:12Z", transition="reload", title="Old"), visit("2026-03-20T08:31:13.9Z", title="")])])
    (r,) = rows.collect()
    assert (r["visit_span_count"], r["transition"], r["title"], bad.count()) == (2, "link", "Old", 0)
    parts = ["pc", "edge", "Default", "https://a.example/x", "2026-03-20T08:31:12+00:00", "2026-03-20T08:31:13.900000+00:00", "link"]
    assert r["page_view_id"] == "browser_history_page_view_" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


@pytest.mark.parametrize(("second", "count"), [("08:00:02", 1), ("08:00:02.000001", 2)])
def test_gap_bound(spark, second, count):
    rows, _ = views_of(spark, [payload([visit("2026-03-20T08:00:00Z"), visit(f"2026-03-20T{second}Z")])])
    assert rows.count() == count


def test_clusters_chain_and_end_with_the_payload(spark):
    texts = [payload([visit("2026-03-20T08:00:00Z"), visit("2026-03-20T08:00:02Z")], "s1"), payload([visit("2026-03-20T08:00:04Z", transition=None)], "s2")]
    assert views_of(spark, texts)[0].count() == 2
    (r,) = views_of(spark, texts, per_payload=False)[0].collect()
    assert (r["visit_span_count"], r["sync_id"]) == (3, "s1")


def test_transitions(spark):
    pick = lambda *names: spark.createDataFrame([(n,) for n in names], "t string").agg(visits.pick_transition(F.col("t")).alias("p")).first()["p"]
    assert pick("reload", "typed", None) == "typed"
    assert pick("zz", "aa", None) == "aa"
    assert pick(None) is None


def test_bad_payloads_are_rejected(spark):
    ok = [visit("2026-03-20T08:00:00Z")]
    texts = [payload(ok, browser="lynx"), payload(ok, sync=""), payload([{"url": "", "visit_time": "2026-03-20T08:00:00Z"}]), payload([visit("then")]), "{not json", json.dumps({"items": []}), payload(ok)]
    rows, bad = views_of(spark, texts)
    assert (rows.count(), bad.count()) == (1, 6)


def test_keep_last_and_ties(spark):
    rows = spark.createDataFrame([("track-1", "Song A", "1"), ("track-1", "Song A+", "2"), ("track-2", "B", "1"), ("track-3", "C", "5"), ("track-3", "D", "5")], "track_id string, name string, updated_at string")
    first = {r["track_id"]: r["name"] for r in dedup.keep_last(rows, ["track_id"], "updated_at").collect()}
    assert first["track-1"] == "Song A+" and len(first) == 3
    assert first == {r["track_id"]: r["name"] for r in dedup.keep_last(rows.repartition(3).orderBy("name"), ["track_id"], "updated_at").collect()}
    assert dedup.keep_last(rows, ["track_id"], "no_such_column").count() == 3
    with pytest.raises(ValueError, match="missing dedupe key"):
        dedup.keep_last(rows, ["id"], "updated_at")


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("", 1)], "id string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2), (None, 2)], "id string, n int")
    assert sorted(tuple(r) for r in dedup.upsert(old, new, "id").collect()) == [("a", 1), ("b", 2), ("c", 2)]
    counts = dedup.ingest_counts(new, old, "id").first()
    assert tuple(counts) == (3, 2, 1)
    assert dedup.only_new(new.union(new), old, "id").count() == 4  # repeats within a batch stay


def test_months_and_cursors(spark, tmp_path):
    assert cursors.target_months(today=date(2024, 1, 3)) == [(2023, 12), (2024, 1)]
    assert cursors.target_months(2020, 5) == [(2020, 5)]
    rows = spark.createDataFrame([(T("2024-01-01"),), (T("2024-01-02"),), (T("2024-01-03"),)], "t timestamp")
    assert cursors.since(rows, "t", "2024-01-01", "2024-01-02").count() == 1
    assert cursors.since(rows, "t", None).count() == 3
    c = cursors.Cursor.of(Lake(spark, str(tmp_path)), "browser_history", "my pc", "edge", "Profile 1/a")
    assert c.read() is None and c.path.endswith("/state/browser_history/my%20pc/edge/Profile%201%2Fa/cursor.json")
    for x in ("x", "y"):
        c.advance(x)
        assert c.read() == x
    ran = []
    with pytest.raises(RuntimeError, match="b: no"):
        cursors.run_all({"a": lambda: ran.append("a"), "b": lambda: (_ for _ in ()).throw(ValueError("no")), "c": lambda: ran.append("c")})
    assert ran == ["a", "c"]


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def plays_frame(spark, rows):
    return spark.createDataFrame(rows, "play_id string, played_at_utc string, track_id string, ms_played bigint")


def test_missing_datasets_and_months_are_empty(spark, lake):
    assert lake.scan("spotify/plays").count() == 0 and not lake.available("spotify/plays") and lake.months("spotify/plays") == []
    sinks.append_events(plays_frame(spark, [("p1", "2024-01-05T00:00:00Z", "t", 1), ("p2", "2024-03-05T00:00:00Z", "t", 1), ("p3", "bad", "t", 1)]), lake, "spotify/plays")
    assert lake.months("spotify/plays") == [(2024, 1), (2024, 3)]
    assert lake.scan("spotify/plays", "2024-01-01", "2024-03-31", "raw").count() == 2
    assert lake.scan("spotify/plays", "2024-02-01", "2024-02-28", "raw").count() == 0
    plan = lake.scan("spotify/plays", "2024-03-01", "2024-03-31", "raw")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_mixed_schemas(spark, lake):
    old = plays_frame(spark, [("p1", "2024-01-05T00:00:00Z", "t", 1)])
    sinks.append_events(old.drop("ms_played"), lake, "spotify/plays")
    sinks.append_events(old.withColumn("play_id", F.lit("p2")), lake, "spotify/plays")
    got = {r["play_id"]: r["ms_played"] for r in lake.scan("spotify/plays", layer="raw").collect()}
    assert got == {"p1": None, "p2": 1}


def test_whole_numbers_written_as_doubles(spark, lake):
    rows = plays_frame(spark, [("p1", "2024-01-05T00:00:00Z", "t", 1)])
    sinks.append_events(rows, lake, "spotify/plays")
    sinks.append_events(rows.withColumns({"play_id": F.lit("p2"), "ms_played": F.lit(2.0)}), lake, "spotify/plays")
    assert sorted((r["play_id"], r["ms_played"]) for r in lake.scan("spotify/plays", "2024-01-01", "2024-01-31", "raw").collect()) == [("p1", 1), ("p2", 2)]
    assert sinks.compact(lake, "spotify/plays") == [(2024, 1)] and lake.scan("spotify/plays").count() == 2


def test_compaction(spark, lake):
    rows = [("p1", "2024-01-05T00:00:00Z", "old", 1), ("p1", "2024-01-06T00:00:00Z", "new", 1), ("p2", "2024-02-06T00:00:00Z", "t", 1)]
    sinks.append_events(plays_frame(spark, rows), lake, "spotify/plays")
    sinks.append_events(plays_frame(spark, rows), lake, "spotify/plays")
    assert jobs.compact_all(lake, ["spotify/plays"]) == {"spotify/plays": [(2024, 1), (2024, 2)]}
    assert sorted(r["track_id"] for r in lake.scan("spotify/plays").collect()) == ["new", "t"]
    assert len(files.matches(spark, f"{lake.folder('spotify/plays')}/year=2024/month=1/*.parquet")) == 1
    sinks.append_events(plays_frame(spark, [("p3", "2024-02-07T00:00:00Z", "t", 1)]), lake, "spotify/plays")
    assert sinks.compact(lake, "spotify/plays", [(2024, 2), (2025, 1)]) == [(2024, 2)]
    assert lake.scan("spotify/plays").count() == 3
    assert sinks.compact(lake, "github/commits") == []


def test_visits_to_watch_events(spark, lake):
    url = "https://www.youtube.com/watch?v=abcdefghijk"
    raw = spark.createDataFrame([(payload([visit("2026-03-20T08:00:00Z", url, "Film"), visit("2026-03-20T09:00:00Z")]),), ("bad",)], "value string")
    assert jobs.ingest_visits(raw, lake, NOW()).count() == 1
    jobs.compact_all(lake, ["browser_history/page_views"])
    assert jobs.derive_watch_events(lake, "s1") is True
    assert jobs.derive_watch_events(lake, "s1") is False
    (e,) = lake.scan("youtube/watch_events", layer="raw").collect()
    view = lake.scan("browser_history/page_views").where(F.col("url") == url).first()
    assert e["watch_event_id"] == f"youtube_watch_event_{uuid.uuid5(uuid.NAMESPACE_URL, f'browser_history:{view["page_view_id"]}:abcdefghijk')}"
    sinks.overwrite_sync(watching.watch_events(lake.scan("browser_history/page_views")), lake, "youtube/watch_events", "browser_history_sync_id")
    assert lake.scan("youtube/watch_events", layer="raw").count() == 1


def test_plays_ingest_moves_the_cursor_last(spark, lake, tmp_path):
    item = {"track": {"id": "t1", "name": "N", "artists": [{"id": "a1", "name": "X"}, {"id": None, "name": "Y"}], "album": {"id": "al", "name": "AL"}, "duration_ms": 5}, "played_at": "2024-01-05T00:00:00Z"}
    text = [json.dumps(item), json.dumps({**item, "played_at": "2024-01-06T00:00:00Z"}), json.dumps({"played_at": "2024-01-07T00:00:00Z"})]
    items = spark.createDataFrame([(t,) for t in text], "v string").select(F.from_json("v", listening.PLAY_ITEM).alias("i")).select("i.*")
    c = cursors.Cursor.of(lake, "test")
    assert jobs.ingest_plays(items, lake, c) == 2 and c.read() == "2024-01-06T00:00:00Z"
    assert jobs.ingest_plays(items, lake, c) == 0
    rows = lake.scan("spotify/plays", layer="raw")
    assert {r["play_id"] for r in rows.collect()} == {"2024-01-05T00:00:00Z_t1", "2024-01-06T00:00:00Z_t1"}
    assert rows.first()["artist_ids"] == ["a1", None]
    tracks, artists = listening.missing_master_ids(rows, lake.scan("spotify/tracks"), lake.scan("spotify/artists"))
    assert ([r[0] for r in tracks.collect()], [r[0] for r in artists.collect()]) == (["t1"], ["a1"])


def play_items(spark, times):
    item = {"track": {"id": "t1", "name": "N", "artists": [{"id": "a1"}, {"id": "a2"}], "duration_ms": 5}}
    return spark.createDataFrame([(json.dumps({**item, "played_at": t}),) for t in times], "v string").select(F.from_json("v", listening.PLAY_ITEM).alias("i")).select("i.*")


def test_cursor_compares_instants(spark, lake):
    c = cursors.Cursor.of(lake, "spotify")
    assert jobs.ingest_plays(play_items(spark, ["2024-01-01T00:00:00Z"]), lake, c) == 1
    assert jobs.ingest_plays(play_items(spark, ["2024-01-01T00:00:00.500Z", "2024-01-01T00:00:00Z"]), lake, c) == 1 and c.read() == "2024-01-01T00:00:00.500Z"
    assert jobs.ingest_plays(play_items(spark, ["2024-01-01T01:00:00.400+01:00"]), lake, c) == 0
    assert jobs.ingest_plays(play_items(spark, [None]), lake, c) == 0  # no instant, so neither before nor after
    assert not files.matches(spark, f"{lake.root}/_staging/*")


def test_play_ids_agree_on_reruns(spark):
    items = play_items(spark, ["", "2024-01-01T00:00:00Z"])
    ids = [sorted(r["play_id"] for r in listening.plays(items).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 2


def test_masters_are_looked_up_landed_and_compacted(spark, lake):
    jobs.ingest_plays(play_items(spark, ["2024-01-01T00:00:00Z"]), lake, cursors.Cursor.of(lake, "spotify"))
    tracks = lambda ids: [{"id": i, "name": "T" + i, "artists": [{"id": "a1", "name": "A"}]} for i in ids]
    artists = lambda ids: [{"id": i, "name": "N" + i, "genres": ["g"], "followers": {"total": 3}} if i != "a2" else None for i in ids]
    assert jobs.enrich_masters(lake, tracks, artists, NOW()) == {"spotify/tracks": 1, "spotify/artists": 1}
    assert jobs.enrich_masters(lake, tracks, artists, NOW()) == {"spotify/tracks": 0, "spotify/artists": 0}
    assert lake.months("spotify/tracks") == [(2026, 3)]
    again = listening.tracks(spark.createDataFrame([(json.dumps({"id": "t1", "name": "new"}),)], "v string").select(F.from_json("v", listening.TRACK).alias("i")).select("i.*"), F.lit("2026-03-21").cast("timestamp"))
    sinks.append_events(again, lake, "spotify/tracks")
    assert jobs.compact_all(lake, ["spotify/plays", "spotify/tracks", "spotify/artists"]) == {"spotify/plays": [(2024, 1)], "spotify/tracks": [(2026, 3)], "spotify/artists": [(2026, 3)]}
    assert [r["name"] for r in lake.scan("spotify/tracks").collect()] == ["new"] and lake.scan("spotify/artists").first()["followers_total"] == 3
    with pytest.raises(RuntimeError, match="youtube/watch_history is not compacted: it has no key"):
        jobs.compact_all(lake, ["youtube/watch_history", "spotify/plays"])
    with pytest.raises(ValueError, match="snapshot"):
        sinks.append_events(lake.scan("youtube/videos"), lake, "youtube/videos")


def videos_frame(spark, ids):
    return spark.createDataFrame([(i, f"T{i}") for i in ids], "video_id string, title string")


@pytest.mark.parametrize("step", ["write", "claim", "text", "clean"])
def test_a_crash_at_any_step_of_an_upsert_loses_nothing(spark, lake, monkeypatch, step):
    from dayloom.sources import snapshots

    ids = lambda: sorted(r["video_id"] for r in lake.scan("youtube/videos").collect())
    sinks.upsert_master(videos_frame(spark, "a"), lake, "youtube/videos")
    sinks.upsert_master(videos_frame(spark, "b"), lake, "youtube/videos")
    boom = lambda *a, **k: (_ for _ in ()).throw(OSError("crash"))
    real = files.create_text
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(sinks, "upsert", boom)
        elif step == "claim":
            m.setattr(snapshots.files, "create_text", boom)
        elif step == "text":  # the pointer is there, but empty
            m.setattr(snapshots.files, "create_text", lambda s, p, t: (real(s, p, ""), boom()))
        else:
            m.setattr(snapshots.files, "delete", boom)
        with pytest.raises(OSError, match="crash"):
            sinks.upsert_master(videos_frame(spark, "c"), lake, "youtube/videos")
    assert ids() == (["a", "b", "c"] if step == "clean" else ["a", "b"])
    sinks.upsert_master(videos_frame(spark, "cd"), lake, "youtube/videos")
    assert ids() == ["a", "b", "c", "d"]


def test_a_faster_writer_is_not_overwritten(spark, lake, monkeypatch):
    from dayloom.sources import snapshots

    sinks.upsert_master(videos_frame(spark, "a"), lake, "youtube/videos")
    real, late = files.create_text, []

    def create(s, path, text):
        if not late:
            late.append(1)
            sinks.upsert_master(videos_frame(spark, "b"), lake, "youtube/videos")
        return real(s, path, text)

    monkeypatch.setattr(snapshots.files, "create_text", create)
    monkeypatch.setattr(snapshots.time, "sleep", lambda s: None)
    sinks.upsert_master(videos_frame(spark, "c"), lake, "youtube/videos")
    assert sorted(r["video_id"] for r in lake.scan("youtube/videos").collect()) == ["a", "b", "c"]
    monkeypatch.setattr(snapshots.files, "create_text", lambda *a: False)
    with pytest.raises(snapshots.ConflictError):
        sinks.upsert_master(videos_frame(spark, "d"), lake, "youtube/videos")


def github_frames(spark):
    repo = {"id": 1, "name": "r", "full_name": "me/r", "owner": {"login": "me"}, "description": "d", "topics": list("abcdefg"), "updated_at": "2024-01-01T00:00:00Z"}
    pull = {"id": 9, "number": 3, "title": "t", "state": "closed", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "merged_at": "2024-01-02T00:00:00Z", "labels": [{"name": "x"}, {"name": ""}], "head": {"ref": "h", "repo": repo}, "base": {"ref": "main"}, "additions": 5}
    other = {**pull, "head": {"ref": "h", "repo": {**repo, "owner": {"login": "you"}}}}
    commit = {"repo_full_name": "me/r", "sha": "abc", "commit": {"message": "m", "author": {"date": "2024-01-03T00:00:00Z"}}, "stats": {"additions": 1, "deletions": 2}}
    load = lambda rows, ddl: spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", ddl).alias("i")).select("i.*")
    commits = [commit, {**commit, "sha": ""}, {**commit, "sha": "def", "files": [{"filename": "f"}]}]
    return load([pull, other], worklog.PULL_ITEM), load(commits, worklog.COMMIT_ITEM), load([repo], worklog.REPO)


def test_worklog(spark, lake):
    pulls, commits, repos = github_frames(spark)
    (p,) = worklog.pull_requests(pulls, "me", NOW()).collect()
    assert (p["action"], p["labels"], p["is_merged"], p["pr_key"]) == ("merged", ["x"], True, hashlib.sha256(b"me/r:3").hexdigest())
    assert p["pr_event_id"] == hashlib.sha256(b"me/r:3:2024-01-02T00:00:00Z:closed").hexdigest()
    c = {r["sha"]: r for r in worklog.commits(commits, NOW()).collect()}
    assert set(c) == {"abc", "def"} and c["abc"]["changed_files_count"] is None and c["def"]["changed_files_count"] == 1 and c["abc"]["owner"] == "me"
    counts = jobs.ingest_worklog(pulls, commits, repos, lake, "me", NOW())
    assert counts["github/commits"] == {"fetched": 2, "new": 2, "duplicates": 0}
    assert jobs.ingest_worklog(pulls, commits, repos, lake, "me", NOW())["github/commits"]["new"] == 0
    assert lake.scan("github/commits", layer="raw").count() == 2
    assert lake.scan("github/repositories").first()["repo_summary_text"] == "d | Topics: a, b, c, d, e"


@pytest.mark.parametrize(
    ("state", "created", "updated", "closed", "merged", "action"),
    [("open", "1", "1", None, None, "opened"), ("open", "1", "2", None, None, "updated"), ("open", "1", "2", "3", None, "reopened"), ("closed", "1", "2", "3", None, "closed"), ("closed", "1", "2", "3", "4", "merged"), (None, "1", "1", None, None, "opened")],
)
def test_pull_actions(spark, state, created, updated, closed, merged, action):
    df = spark.createDataFrame([(state, created, updated, closed, merged)], "s string, c string, u string, x string, m string")
    assert df.select(worklog.pull_action(*[F.col(c) for c in "scuxm"])).first()[0] == action


def test_video_masters(spark):
    item = {"id": "v", "snippet": {"title": "T", "publishedAt": "2024-01-01T00:00:00Z", "thumbnails": {"medium": {"url": "m"}, "default": {"url": "d"}}}, "contentDetails": {"duration": "PT2M"}, "statistics": {"viewCount": "12", "likeCount": "x"}}
    load = lambda ddl: spark.createDataFrame([(json.dumps(item),)], "v string").select(F.from_json("v", ddl).alias("i")).select("i.*")
    v = watching.videos(load(watching.VIDEO_ITEM), NOW()).first()
    assert (v["duration_seconds"], v["view_count"], v["like_count"], v["thumbnail_url"]) == (120, 12, None, "m")
    assert watching.channels(load(watching.CHANNEL_ITEM), NOW()).first()["channel_name"] == "T"


def test_watch_history_and_enrichment(spark):
    rows = spark.createDataFrame([("v", "T", "C", "2024-01-01T00:00:00Z", "u"), ("", "T", "C", "2024-01-01T00:00:00Z", "u"), ("v", "T", "C", "then", "u")], "video_id string, title string, channel_name string, watched_at string, video_url string")
    (r,) = watching.watch_history(rows, "account1").collect()
    assert r["watch_id"] == hashlib.sha256(b"account1_v_2024-01-01 00:00:00+00:00").hexdigest()[:16]
    events = conform(spark.createDataFrame([("v", "old", "", None)], "video_id string, video_title string, channel_id string, channel_name string"), DATASETS["youtube/watch_events"].schema)
    masters = conform(spark.createDataFrame([("v", "", "c1", "N")], "video_id string, title string, channel_id string, channel_name string"), DATASETS["youtube/videos"].schema)
    e = watching.enrich(events, masters).first()
    assert (e["video_title"], e["channel_id"], e["channel_name"]) == ("old", "c1", "N")


def test_export_pages(spark):
    cell = lambda title, links, at: f'<div class="outer-cell mdl-cell"><p class="mdl-typography--title">{title}<br></p><div class="content-cell mdl-typography--body-1">{links}<br>{at}<br></div><div class="content-cell mdl-typography--body-1 mdl-typography--text-right"></div></div>'
    video = '<a href="https://www.youtube.com/watch?v=abcdefghijk">Film</a> watched <a href="https://www.youtube.com/channel/UC1">Maker</a>'
    html = "<html>" + cell("YouTube", video, "2024/05/06 07:08:09 JST") + cell("Maps", video, "2024/05/06 07:08:09 JST") + cell("YouTube", video, "no time") + "</html>"
    (e,) = watching.exported_events(spark.createDataFrame([(html,)], "html string"), NOW()).collect()
    assert (e["video_id"], e["video_title"], e["channel_id"], e["channel_name"], e["content_type"]) == ("abcdefghijk", "Film", "UC1", "Maker", "video")
    assert e["watch_event_id"] == f"youtube_watch_event_{uuid.uuid5(uuid.NAMESPACE_URL, 'google_takeout:abcdefghijk:2024-05-05T22:08:09+00:00')}"


def test_mirror(tmp_path):
    (tmp_path / "a" / "x").mkdir(parents=True)
    (tmp_path / "a" / "x" / "f").write_text("1")
    assert files.mirror(tmp_path / "a", tmp_path / "b")["copied"] == 1
    assert files.mirror(tmp_path / "a", tmp_path / "b") == {"copied": 0, "skipped": 1, "failed": []}


def test_local_mirror_is_preferred(spark, tmp_path):
    remote, local = Lake(spark, str(tmp_path / "r")), Lake(spark, str(tmp_path / "l"))
    for lake, n in ((remote, "far"), (local, "near")):
        sinks.append_events(plays_frame(spark, [("p", "2024-01-05T00:00:00Z", n, 1)]), lake, "spotify/plays")
        sinks.compact(lake, "spotify/plays")
    sinks.append_events(plays_frame(spark, [("q", "2024-02-05T00:00:00Z", "far", 1)]), remote, "spotify/plays")
    sinks.compact(remote, "spotify/plays")
    both = Lake(spark, str(tmp_path / "r"), str(tmp_path / "l"))
    assert {r["play_id"]: r["track_id"] for r in both.scan("spotify/plays").collect()} == {"p": "near", "q": "far"}  # each month from where it is
    assert both.months("spotify/plays", "compacted") == [(2024, 1), (2024, 2)]
    sinks.upsert_master(videos_frame(spark, "a"), remote, "youtube/videos")
    files.mirror(tmp_path / "r" / "compacted", tmp_path / "l" / "compacted")
    assert Lake(spark, str(tmp_path / "none"), str(tmp_path / "l")).scan("youtube/videos").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    base = T("2026-03-20 08:00:00")
    rows = [("pc", "edge", "D", f"u{i % 3}", base + timedelta(seconds=(i * 7) % 40), f"t{i}", "link") for i in range(40)]
    frame = spark.createDataFrame(rows, "source_device string, browser string, profile string, url string, visit_time timestamp, title string, transition string")
    for i in range(2):  # clusters run over the files
        frame.where(F.col("title").isin([f"t{k}" for k in range(i, 40, 2)])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.page_view_sessions(streams.file_stream(spark, str(tmp_path / "in"), frame.schema, 1))
    work = streams.once_per_batch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "ledger"))
    streams.run_available(stream, str(tmp_path / "ck"), work, "complete")
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    batch = visits.cluster(frame, ["source_device", "browser", "profile", "url"], "visit_time").groupBy("url", "cluster_no").agg(F.count(F.lit(1)).alias("n"), visits.pick_title(F.col("title"), F.col("visit_time")).alias("title"))
    assert sorted(tuple(r) for r in last.select("url", "visit_span_count", "title").collect()) == sorted(tuple(r) for r in batch.select("url", "n", "title").collect())


def test_batches_run_once(spark, tmp_path):
    done = []
    run = streams.once_per_batch(lambda b, n: done.append(n), str(tmp_path / "ledger"))
    for n in (0, 0, 1):
        run(spark.range(1), n)
    assert done == [0, 1]


def test_masters_enrich_stored_events(spark, lake):
    events = conform(spark.createDataFrame([("e1", T("2024-01-01"), "v", "old", "short"), ("e2", T("2024-02-01"), "w", "W", "video")], "watch_event_id string, watched_at_utc timestamp, video_id string, video_title string, content_type string"), DATASETS["youtube/watch_events"].schema)
    sinks.append_events(events, lake, "youtube/watch_events")
    videos = spark.createDataFrame([("v", "New", "c")], "video_id string, title string, channel_id string")
    channels = spark.createDataFrame([("c", "C")], "channel_id string, channel_name string")
    for _ in range(2):  # the second run replaces masters that it also reads
        got = {r["video_id"]: r["video_title"] for r in jobs.enrich_watch_events(lake, videos, channels).collect()}
        assert got == {"v": "New", "w": "W"}
    assert [r["content_type"] for r in lake.scan("youtube/videos").collect()] == ["short"] and lake.available("youtube/channels")


def test_watch_history_cursor(spark, lake, tmp_path):
    items = spark.createDataFrame([("v", "T", "C", "2024-01-01T00:00:00Z", "u"), ("w", "T", "C", "2024-01-03T00:00:00Z", "u")], "video_id string, title string, channel_name string, watched_at string, video_url string")
    c = cursors.Cursor.of(lake, "test")
    assert jobs.ingest_watch_history(items, "a", lake, c, "2024-01-02") == 1
    assert jobs.ingest_watch_history(items, "a", lake, c) == 0 and c.read() == "2024-01-03 00:00:00"
    assert lake.scan("youtube/watch_history", layer="raw").count() == 1


def test_export_import(spark, lake):
    cell = '<div class="outer-cell"><p class="mdl-typography--title">YouTube</p><div class="mdl-typography--body-1"><a href="https://youtu.be/abcdefghijk">F</a>{}<br></div></div>'
    pages = spark.createDataFrame([(cell.format("2024/05/06 07:08:09 JST") + cell.format("2025/05/06 07:08:09 JST"),)], "html string")
    for _ in range(2):  # a rerun lands nothing more
        row = jobs.import_export(pages, lake, NOW(), after="2024-01-01", before="2025-01-01").first()
        assert (row["events"], row["videos"], row["without_channel"]) == (1, 1, 1) and lake.scan("youtube/watch_events", layer="raw").count() == 1


def test_window_pages(spark):
    rows = spark.range(10).select(F.timestamp_seconds("id").alias("t"))
    assert [r["t"].second for r in cursors.window_page(rows, "t", "1970-01-01 00:00:02", "1970-01-01 00:00:08", 3).collect()] == [8, 7, 6]
