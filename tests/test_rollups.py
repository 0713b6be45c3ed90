"""Rollups with exact distinct counts, chains of jobs, accounts, providers and quotas."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from dayloom.operators import jobs, rollups
from dayloom.plans import music
from dayloom.sources import sinks
from dayloom.sources.catalog import Lake
from dayloom.sources.paged import ServiceError, lookup
from tests.test_page_view_stream import payloads


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))


def plays(spark, seed, days):
    r = random.Random(seed)
    rows = [(f"p{seed}-{i}", f"2024-{1 + (d := r.choice(days)) // 28:02d}-{1 + d % 28:02d}T10:00:00Z", r.choice([None, *[f"t{x}" for x in range(40)]]), r.randrange(1000)) for i in range(400)]
    return spark.createDataFrame(rows, "play_id string, played_at_utc string, track_id string, ms_played bigint")


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
def test_rollups_give_what_events_give_and_read_none(spark, lake, granularity):
    shown = lambda df: sorted(map(repr, df.select("period", "total_ms", "track_count", "unique_tracks").collect()))
    names = {"ms_played": "total_ms", "n": "track_count", "unique_track_id": "unique_tracks"}
    for seed, days in ((1, range(0, 80)), (2, range(40, 140))):  # the second landing brings new ids and months
        sinks.append_events(plays(spark, seed, days), lake, "spotify/plays")
        sinks.append_events(plays(spark, seed, days), lake, "spotify/plays")  # repeats, which compaction folds
        rollups.compact(lake, rollups.PLAYS)
        for start, end in (("2024-01-01", "2024-12-31"), ("2024-01-20", "2024-03-05")):
            got = rollups.stats(lake, rollups.PLAYS, start, end, granularity).withColumnsRenamed(names)
            assert shown(got) == shown(music.listening_stats(lake.scan("spotify/plays", start, end), start, end, granularity))
            assert not [f for f in got.inputFiles() if "/rollups/" not in f]


def test_a_refresh_touches_its_months_alone(spark, lake):
    sinks.append_events(plays(spark, 1, range(0, 80)), lake, "spotify/plays")
    rollups.compact(lake, rollups.PLAYS)
    one = lambda: [r["n"] for r in rollups.stats(lake, rollups.PLAYS, "2024-01-01", "2024-12-31", "month").orderBy("period").collect()]
    before = one()
    sinks.append_events(plays(spark, 3, range(0, 80)), lake, "spotify/plays")
    assert rollups.compact(lake, rollups.PLAYS, [(2024, 2)]) == [(2024, 2)]
    assert [a == b for a, b in zip(before, one())] == [True, False, True] and rollups.refresh(lake, rollups.WATCHED) == []


def test_a_push_is_landed_compacted_and_derived_in_one_chain(spark, lake):
    made = payloads(3, 6)
    made[0]["items"][0] |= {"url": "https://www.youtube.com/watch?v=abcdefghijk", "title": "Video"}
    lines = [json.dumps(p) for p in made] + ["{}", "not json"]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    done = jobs.ingest_compact_derive(raw, lake, F.lit("2024-03-01").cast("timestamp"))
    assert done["rejected"] == 2 and done["months"][0] == (2024, 1) and set(done["derived"].values()) == {True}
    assert lake.scan("youtube/watch_events", layer="raw").first()["video_id"] == "abcdefghijk"
    views = lake.scan("browser_history/page_views").count()
    again = jobs.ingest_compact_derive(raw, lake, F.lit("2024-03-01").cast("timestamp"))
    assert set(again["derived"].values()) == {False} and lake.scan("browser_history/page_views").count() == views


def test_accounts_are_isolated(spark, lake):
    items = spark.createDataFrame([("v1", "T", "c", "2024-01-01T00:00:00Z", "u")], "video_id string, title string, channel_name string, watched_at string, video_url string")
    broken = items.withColumn("video_id", F.raise_error(F.lit("refused")).cast("string"))
    with pytest.raises(RuntimeError, match="^two: "):
        jobs.ingest_accounts({"one": items, "two": broken, "three": items}, lake)
    assert lake.scan("youtube/watch_history", layer="raw").select("account_id").distinct().count() == 2
    assert jobs.ingest_accounts({"one": items, "three": items}, lake) == {"one": 0, "three": 0}


def test_providers_are_selected(spark, lake):
    sinks.append_events(plays(spark, 1, range(3)), lake, "spotify/plays")
    assert jobs.compact_providers(lake, ["spotify"]) == {"spotify/plays": [(2024, 1)], "spotify/tracks": [], "spotify/artists": []}
    assert "github/commits" in jobs.compact_providers(lake)
    with pytest.raises(ValueError, match="unknown providers: tape"):
        jobs.compact_providers(lake, ["spotify", "tape"])


def test_a_quota_ends_the_asking_where_that_is_wanted(spark):
    ids = spark.createDataFrame([(f"{i:02d}",) for i in range(30)], "id string").coalesce(1)

    def fetch(part):
        if "20" <= max(part):
            raise ServiceError(403, quota=True)
        return [{"id": i} for i in part]

    with pytest.raises(Exception, match="status 403"):
        lookup(ids, "id", fetch, 1).collect()
    assert 0 <= lookup(ids, "id", fetch, 1, quota_ends=True).count() < 30
    with pytest.raises(Exception, match="status 404"):
        lookup(ids, "id", lambda part: (_ for _ in ()).throw(ServiceError(404)), quota_ends=True).collect()
