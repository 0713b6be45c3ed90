"""What is new against what is stored, by filters of files, against the plain anti join."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dayloom.operators import dedup, jobs
from dayloom.sources import files, key_filters, sinks
from dayloom.sources.catalog import Lake

NAME = "github/commits"


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))


def commits(spark, ids, month=1):
    rows = [(i, f"2024-{month:02d}-03T00:00:00Z" if month else "?") for i in ids]
    return spark.createDataFrame(rows, "commit_event_id string, committed_at_utc string").coalesce(1)


def test_only_files_that_can_hold_a_key_are_read(spark, lake):
    for month in range(1, 9):
        sinks.append_events(commits(spark, [f"{month}-{i}" for i in range(50)], month), lake, NAME)
    assert key_filters.index(lake, NAME) == 8 and key_filters.index(lake, NAME) == 0
    incoming = commits(spark, ["3-7", "new-1", "3-7", "new-1", "7-49"], 3)
    chosen = key_filters.may_hold(lake, NAME, incoming.select("commit_event_id"))
    assert {f.split("/")[1] for f in chosen} == {"month=3", "month=7"}
    fresh = key_filters.only_new(lake, NAME, incoming)
    assert {f.split("/")[-2] for f in fresh.inputFiles() if "/year=" in f} == {"month=3", "month=7"}
    assert sorted(r[0] for r in fresh.select("commit_event_id").collect()) == ["new-1", "new-1"]
    # a file that nobody has indexed is read; history that nobody needs is not
    sinks.append_events(commits(spark, ["late"], 11), lake, NAME)
    assert key_filters.may_hold(lake, NAME, commits(spark, ["none"]).select("commit_event_id"))[0].startswith("year=2024/month=11")
    assert key_filters.only_new(lake, NAME, commits(spark, ["late", "none"])).count() == 1


def test_filters_agree_with_the_plain_anti_join(spark, lake, monkeypatch):
    r = random.Random(5)
    incoming = commits(spark, [f"k{r.randrange(9000)}" for _ in range(400)] + [None, ""])
    assert key_filters.only_new(lake, NAME, incoming).count() == 402  # nothing is stored
    for month in (1, 2, 5):
        sinks.append_events(commits(spark, [f"k{r.randrange(9000)}" for _ in range(2500)] + [None], month), lake, NAME)
    sinks.append_events(commits(spark, [None, None], 6), lake, NAME)
    rows = lambda df: sorted(map(repr, df.select("commit_event_id").collect()))
    wanted = rows(dedup.only_new(incoming, lake.scan(NAME, layer="raw"), "commit_event_id"))
    assert rows(key_filters.only_new(lake, NAME, incoming)) == wanted
    key_filters.index(lake, NAME)
    assert rows(key_filters.only_new(lake, NAME, incoming)) == wanted
    monkeypatch.setattr(key_filters, "MOST_CHECKS", 10)
    assert rows(key_filters.only_new(lake, NAME, incoming)) == wanted
    assert lake.scan(NAME, layer="raw").count() == 7505  # readers do not see the filters


def test_what_a_task_holds_does_not_grow_with_the_input(spark, lake, monkeypatch):
    stored = [f"k{i}" for i in range(3000)]
    for month in (1, 2):
        sinks.append_events(commits(spark, stored[month - 1 :: 2] + [None], month), lake, NAME)
    key_filters.index(lake, NAME)
    incoming = commits(spark, [f"k{i}" for i in range(2800, 3300)] + ["k3200"], 3)
    fresh = key_filters.only_new(lake, NAME, incoming)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # neither keys of history nor of the batch go to every task
    assert sorted(r[0] for r in fresh.select("commit_event_id").collect()) == sorted([f"k{i}" for i in range(3000, 3300)] + ["k3200"])
    # the bitmaps hold the places of their file's keys and no others
    filters = lake.spark.read.parquet(f"{lake.folder(NAME, 'raw')}/{key_filters.FOLDER}")
    places = lake.read(NAME, "raw").where("commit_event_id IS NOT NULL").select("month", F.explode(key_filters.positions(F.col("commit_event_id"), F.lit(32_768))).alias("place"))
    wanted = places.groupBy("month").agg(F.bitmap_construct_agg("place").alias("bitmap")).collect()
    assert {bytes(r["bitmap"]) for r in filters.collect()} == {bytes(r["bitmap"]) for r in wanted} and filters.count() == 2
    # landing is dealt to tasks by its number of rows: 501 by 100
    monkeypatch.setattr(jobs, "TASK_ROWS", 100)
    assert jobs.land_new(incoming, lake, NAME) == {"fetched": 501, "new": 301, "duplicates": 200, "unreadable": 0}
    assert len(files.matches(spark, f"{lake.folder(NAME, 'raw')}/year=2024/month=3/*.parquet")) == 6


def test_filters_grow_with_their_file(spark, lake):
    sinks.append_events(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("commit_event_id"), F.lit("2024-01-01T00:00:00Z").alias("committed_at_utc")).coalesce(1), lake, NAME)
    key_filters.index(lake, NAME)
    stored = lake.spark.read.parquet(f"{lake.folder(NAME, 'raw')}/{key_filters.FOLDER}")
    assert {r["bits"] for r in stored.collect()} == {262_144} and stored.count() == 8
    assert key_filters.may_hold(lake, NAME, spark.createDataFrame([("k19999",)], "k string"))
    absent = spark.range(20_000, 40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    place = key_filters.positions(F.col("key"), F.lit(262_144))
    held = stored.select("bucket", "bitmap")
    probes = absent.select("key", F.explode(place).alias("p")).join(held, F.floor(F.col("p") / key_filters.BUCKET) == F.col("bucket"))
    hits = probes.where(key_filters.is_set(F.col("bitmap"), F.pmod("p", F.lit(key_filters.BUCKET)))).groupBy("key").count().where(f"count = {key_filters.HASHES}").count()
    assert hits < 20_000 * 0.02


def test_a_landing_counts_and_reads_its_source_once(spark, lake):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    live = commits(spark, ["a", "b", "c", "c"]).unionByName(commits(spark, ["d"], 0)).mapInArrow(count, "commit_event_id string, committed_at_utc string")
    assert jobs.land_new(live, lake, NAME) == {"fetched": 5, "new": 4, "duplicates": 0, "unreadable": 1}
    assert reads.value == 5
    assert jobs.land_new(commits(spark, ["a", "e", "c"]), lake, NAME) == {"fetched": 3, "new": 1, "duplicates": 2, "unreadable": 0}
    assert jobs.land_new(commits(spark, ["a"]).limit(0), lake, NAME) == {"fetched": 0, "new": 0, "duplicates": 0, "unreadable": 0}
    assert lake.scan(NAME, layer="raw").count() == 5 and not files.matches(spark, f"{lake.root}/_staging/*")
