"""Page views of a stream of payloads: however visits are cut into batches, the same views are landed."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dayloom.operators import visits
from dayloom.sources.catalog import Lake
from dayloom.streaming import page_views, streams

COLUMNS = ["sync_id", "page_view_id", "started_at_utc", "ended_at_utc", "url", "title", "browser", "profile", "source_device", "transition", "visit_span_count", "synced_at_utc"]


def payloads(seed, n):
    """Payloads of visits a few tenths of a second to four seconds apart, at the turn of a month."""
    r = random.Random(seed)
    at, made = datetime(2024, 1, 31, 23, 59, 20, tzinfo=UTC), []
    for i in range(n):
        items = []
        for _ in range(r.randrange(1, 6)):
            at += timedelta(milliseconds=r.choice([0, 300, 1900, 2000, 2001, 4000]))
            items.append({"url": f"https://h/{r.randrange(3)}", "visit_time": at.isoformat().replace("+00:00", "Z"), "title": r.choice(["", "A", "B", None]), "visit_id": str(i), "transition": r.choice(["link", "typed", "x", None])})
        made.append({"sync_id": f"s{r.randrange(n):03d}", "source_device": "d", "browser": "chrome", "profile": "p", "synced_at": at.isoformat(), "items": items})
    return made


def land(spark, base, lake, files_of_lines):
    """One file and so one batch for each list of payloads."""
    folder = base / "in"
    folder.mkdir(exist_ok=True)
    stream, work = page_views.page_view_stream(page_views.payload_files(spark, str(folder), 1), lake, F.lit("2024-03-01").cast("timestamp"), "3650 days")
    for n, lines in enumerate(files_of_lines):
        (folder / f"{len(list(folder.iterdir())):04d}-{n}.json").write_text("\n".join(map(json.dumps, lines)))
    streams.run_available(stream, str(base / "checkpoint"), work, "update")


def whole(spark, made):
    good, _ = visits.parse_payloads(spark.createDataFrame([(json.dumps(p),) for p in made], "value string"))
    found = visits.page_views(visits.visits(good), F.lit("2024-03-01").cast("timestamp"), per_payload=False)
    return sorted(map(repr, found.select(*COLUMNS).collect()))


@pytest.mark.parametrize("shuffled", [False, True])
def test_any_cut_lands_the_views_of_one_batch(spark, tmp_path, shuffled):
    made = payloads(int(shuffled), 24)
    order = random.Random(9).sample(made, len(made)) if shuffled else made
    lake = Lake(spark, str(tmp_path / "lake"))
    cuts = [order[:1], order[1:9], order[9:10], order[10:]]
    land(spark, tmp_path, lake, cuts[:2])
    land(spark, tmp_path, lake, cuts[2:])  # a new start takes the state from the checkpoint
    got = lake.scan("browser_history/page_views")
    assert sorted(map(repr, got.select(*COLUMNS).collect())) == whole(spark, made)
    assert lake.months("browser_history/page_views", "compacted")[0] == (2024, 1)


def test_a_view_is_corrected_where_it_was_landed(spark, tmp_path):
    at = lambda s: f"2024-01-31T23:59:{s}Z" if s < "60" else "2024-02-01T00:00:00Z"
    visit = lambda s: {"url": "https://h/", "visit_time": at(s), "title": "T", "visit_id": s, "transition": "link"}
    payload = lambda n, *seconds: {"sync_id": f"s{n}", "source_device": "d", "browser": "chrome", "profile": "p", "synced_at": at("59"), "items": [visit(s) for s in seconds]}
    lake = Lake(spark, str(tmp_path / "lake"))
    spans = lambda: sorted((r["started_at_utc"].second, r["visit_span_count"]) for r in lake.scan("browser_history/page_views").collect())
    land(spark, tmp_path, lake, [[payload(1, "55", "60")]])
    assert spans() == [(0, 1), (55, 1)] and len(lake.months("browser_history/page_views", "compacted")) == 2
    land(spark, tmp_path, lake, [[payload(2, "57")], [payload(3, "59")]])
    assert spans() == [(55, 4)]  # one view, and the month that it left is empty
    assert lake.months("browser_history/page_views", "compacted") == [(2024, 1)]


def test_clusters_leave_the_state_when_the_watermark_has_passed():
    class State:
        def __init__(self, held, watermark, timed_out=False):
            self.get, self.exists, self.hasTimedOut, self.watermark = (json.dumps(held),), bool(held), timed_out, watermark
            self.kept = self.timeout = None

        def getCurrentWatermarkMs(self):
            return self.watermark

        def update(self, value):
            self.kept = json.loads(value[0])

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def remove(self):
            self.kept = []

    one = {"sync_id": "s", "first": 1_000_000, "last": 2_000_000, "title_at": None, "title": None, "rank": None, "transition": None, "visit_span_count": 1, "synced": 1}
    two = {**one, "first": 9_000_000, "last": 9_500_000}
    state = State([one, two], 5_000, timed_out=True)
    assert list(page_views.changes_of(("d", "b", "p", "u"), iter([]), state)) == [] and state.kept == [two] and state.timeout == 11_501
    state = State([two], 12_000, timed_out=True)
    assert list(page_views.changes_of(("d", "b", "p", "u"), iter([]), state)) == [] and state.kept == []


@pytest.mark.parametrize("width", ["INTERVAL 3 SECONDS", "INTERVAL 1 HOUR"])
def test_clusters_of_ranges_are_clusters_of_keys(spark, width):
    r = random.Random(6)
    rows = []
    for key in ("hot", "hot", "hot", "cold", None):
        at = 0.0
        for _ in range(150):
            at += r.choice([0, 0.3, 1.9, 2, 2.000001, 2.5, 9])
            rows.append((key, None if r.random() < 0.03 else datetime(2024, 1, 1) + timedelta(seconds=at), r.random()))
    df = spark.createDataFrame(rows, "url string, visit_time timestamp, x double").repartition(7)
    show = lambda d: sorted(map(repr, d.where("visit_time IS NOT NULL").select("url", "visit_time", "x", "cluster_no").collect()))
    assert show(visits.cluster_ranges(df, ["url"], "visit_time", width=width)) == show(visits.cluster(df, ["url"], "visit_time"))
    assert visits.cluster_ranges(df, ["url"], "visit_time", width=width).count() == len(rows)


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(40_000).select(F.concat(F.lit("https://hot/"), F.col("id") * 0).alias("url"), F.timestamp_seconds(F.col("id") * 7).alias("visit_time"))
    tasks = lambda d: len(d.groupBy(F.spark_partition_id().alias("p")).agg(F.max("cluster_no")).collect())
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks(visits.cluster(df, ["url"], "visit_time")) == 1
        assert tasks(visits.cluster_ranges(df, ["url"], "visit_time")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_batches_are_merged_without_a_python_call_for_each_key(spark, tmp_path):
    made = payloads(7, 12)
    lake = Lake(spark, str(tmp_path / "lake"))
    good, _ = visits.parse_payloads(spark.createDataFrame([(json.dumps(p),) for p in made], "value string"))
    rows = visits.visits(good)
    none = spark.createDataFrame([], ", ".join([*(f"{k} string" for k in page_views.KEYS), page_views.CLUSTER]))
    plan = page_views.merge(none, rows.select(*page_views.KEYS, *page_views.single()))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    now = F.lit("2024-03-01").cast("timestamp")
    parts = [rows.where(F.crc32("sync_id") % 2 == i) for i in (0, 1)]
    for n, part in [(0, parts[0]), (1, parts[1]), (1, parts[1])]:  # a batch that is repeated
        page_views.land_visits(part, n, lake, now, "3650 days")
    assert sorted(map(repr, lake.scan("browser_history/page_views").select(*COLUMNS).collect())) == whole(spark, made)
    late = rows.withColumn("visit_time", F.expr("visit_time - INTERVAL 2 DAYS"))
    page_views.land_visits(late, 2, lake, now, "1 day")
    assert sorted(map(repr, lake.scan("browser_history/page_views").select(*COLUMNS).collect())) == whole(spark, made)


def test_changes_as_a_stream_land_the_same_views(spark, tmp_path):
    made = payloads(8, 12)
    lake = Lake(spark, str(tmp_path / "lake"))
    (tmp_path / "in").mkdir()
    for n in (0, 1):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, made[n::2])))
    good, _ = visits.parse_payloads(page_views.payload_files(spark, str(tmp_path / "in"), 1))
    work = lambda batch, _: page_views.land_changes(batch, lake, F.lit("2024-03-01").cast("timestamp"))
    streams.run_available(page_views.changes(visits.visits(good), "3650 days"), str(tmp_path / "checkpoint"), work, "update")
    assert sorted(map(repr, lake.scan("browser_history/page_views").select(*COLUMNS).collect())) == whole(spark, made)
