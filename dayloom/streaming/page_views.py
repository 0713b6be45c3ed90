"""Page views of a stream of visits: open clusters are kept as state, and a view that a later visit prolongs or joins to another is corrected where it was landed.

State is kept for each device, browser, profile and url: the clusters that a visit may still join. A micro-batch's visits are merged into them; what changes comes out
as rows to take back and rows to land. A cluster leaves the state once the watermark has passed its end and the gap. Whatever the cut of visits into batches
and their order, within the lateness, what is landed is what one batch of all visits gives.

The state is a table in the lake, a folder for each batch, and merging is a join of that table with the batch, by Spark's own windows and aggregates. Where changes are
wanted as a stream, ``changes`` keeps the same clusters in Spark's state store instead, at the cost of a Python call for each key of a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dayloom.operators.jobs import staged
from dayloom.operators.visits import GAP_SECONDS, parse_payloads, rank_of, view_columns, visits
from dayloom.session import ship
from dayloom.sources import files, sinks
from dayloom.sources.catalog import Lake, conform

KEYS = ["source_device", "browser", "profile", "url"]
CLUSTER = "sync_id string, first long, last long, title_at long, title string, rank int, transition string, visit_span_count long, synced long"
NAME = "browser_history/page_views"


def joined(a: dict, b: dict) -> dict:
    """Two clusters as one: least sync, earliest and latest visit, last title, transition of least rank, both counts."""
    title = max(([x["title_at"], x["title"]] for x in (a, b) if x["title_at"] is not None), default=[None, None])
    way = min(([x["rank"], x["transition"]] for x in (a, b) if x["rank"] is not None), default=[None, None])
    return {
        "sync_id": min(a["sync_id"], b["sync_id"]), "first": min(a["first"], b["first"]), "last": max(a["last"], b["last"]), "title_at": title[0], "title": title[1],
        "rank": way[0], "transition": way[1], "visit_span_count": a["visit_span_count"] + b["visit_span_count"], "synced": max(a["synced"], b["synced"]),
    }


def merged(clusters: list[dict], gap: int) -> list[dict]:
    """Clusters in order of time, those within ``gap`` microseconds of one another joined."""
    out: list[dict] = []
    for c in sorted(clusters, key=lambda c: (c["first"], c["last"])):
        if out and c["first"] <= out[-1]["last"] + gap:
            out[-1] = joined(out[-1], c)
        else:
            out.append(c)
    return out


def changes_of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a key's new visits change among its clusters: a row with the clusters taken back and the new ones.

    Clusters come and go as JSON text, one column, since frames are as many as keys and small: their making is most of the work.
    """
    gap = GAP_SECONDS * 1_000_000
    held = json.loads(state.get[0]) if state.exists else []
    fresh = [] if state.hasTimedOut else [json.loads(text) for batch in batches for text in batch["cluster"].tolist()]
    now = merged(held + fresh, gap)
    passed = state.getCurrentWatermarkMs() * 1000
    open_ = [c for c in now if c["last"] + gap >= passed]
    if open_:
        state.update((json.dumps(open_),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (open_[0]["last"] + gap) // 1000 + 1))
    elif state.exists:
        state.remove()
    gone, new = [c for c in held if c not in now], [c for c in now if c not in held]
    if gone or new:
        yield pd.DataFrame({**{k: [v] for k, v in zip(KEYS, key)}, "gone": [json.dumps(gone)], "new": [json.dumps(new)]})


def single() -> list[Column]:
    """The columns of ``CLUSTER`` of clusters of one visit."""
    micros = lambda c: F.unix_micros(F.col(c))
    titled = F.coalesce(F.col("title") != "", F.lit(False))
    return [
        F.col("sync_id"), micros("visit_time").alias("first"), micros("visit_time").alias("last"), F.when(titled, micros("visit_time")).alias("title_at"), F.when(titled, F.col("title")).alias("title"),
        F.when(F.col("transition").isNotNull(), rank_of(F.col("transition"))).alias("rank"), F.col("transition"), F.lit(1).cast("long").alias("visit_span_count"), micros("synced_at_utc").alias("synced"),
    ]


def changes(rows: DataFrame, lateness: str) -> DataFrame:
    """Changes of clusters from a stream of visits (as ``visits.visits`` gives them): the key, ``CLUSTER`` and taken_back."""
    ship(rows.sparkSession)
    cluster = F.to_json(F.struct(*single()), {"ignoreNullFields": "false"})
    timed = rows.withWatermark("visit_time", lateness).select(*KEYS, "visit_time", cluster.alias("cluster"))
    texts = ", ".join(f"{c} string" for c in [*KEYS, "gone", "new"])
    found = timed.groupBy(*KEYS).applyInPandasWithState(changes_of, texts, "clusters string", "update", GroupStateTimeout.EventTimeTimeout)
    read = lambda c, taken: F.transform(F.from_json(c, f"array<struct<{CLUSTER}>>"), lambda x: F.struct(x.alias("c"), F.lit(taken).alias("taken_back")))
    return found.select(*KEYS, F.explode(F.concat(read("gone", True), read("new", False))).alias("x")).select(*KEYS, "x.c.*", "x.taken_back")


def merge(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Clusters ``held`` and those of a batch (``KEYS`` and ``CLUSTER``), joined where they are within the gap: with ``gone``, the held ones that are part of each, and ``changed``."""
    gap = GAP_SECONDS * 1_000_000
    both = held.withColumn("_held", F.lit(True)).unionByName(fresh.withColumn("_held", F.lit(False)))
    order = Window.partitionBy(*KEYS).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("first") > reach + gap), 1).otherwise(0)
    numbered = both.withColumn("_starts", starts).withColumn("_cluster", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined_ = numbered.groupBy(*KEYS, "_cluster").agg(
        F.min("sync_id").alias("sync_id"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.when(F.col("title_at").isNotNull(), F.struct("title_at", "title"))).alias("_title"),
        F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "transition"))).alias("_way"), F.sum("visit_span_count").alias("visit_span_count"), F.max("synced").alias("synced"),
        F.collect_list(F.when(F.col("_held"), F.struct("first", "last", "transition"))).alias("gone"), F.bool_or(~F.col("_held")).alias("changed"),
    )
    return joined_.select(*KEYS, "sync_id", "first", "last", "_title.title_at", "_title.title", "_way.rank", "_way.transition", "visit_span_count", "synced", "gone", "changed")


def land_visits(rows: DataFrame, number: int, lake: Lake, ingested_at: Column, lateness: str) -> None:
    """Merge a batch of visits into the state that the batch before left, land what changes and leave the state for the next. Repeating the batch does no harm.

    Visits that come later than ``lateness`` after the latest one of earlier batches are left out. The first batch of a stream begins without state.
    """
    spark, folder = rows.sparkSession, f"{lake.root}/state/{NAME}_stream"
    kept = {int(p.rstrip("/").rsplit("=", 1)[1]): p for p in files.matches(spark, f"{folder}/batch=*")}
    before = max((n for n in kept if n < number), default=None)
    schema = ", ".join([*(f"{k} string" for k in KEYS), CLUSTER])
    held = spark.read.schema(schema).parquet(kept[before]) if before is not None else spark.createDataFrame([], schema)
    passed = held.agg((F.unix_micros(F.timestamp_micros(F.max("last")) - F.expr(f"INTERVAL {lateness}"))).alias("at")).first()["at"]
    fresh = rows.select(*KEYS, *single())
    if passed is not None:
        fresh = fresh.where(F.col("first") > passed)
    with staged(merge(held, fresh), lake) as now:
        still = now if passed is None else now.where(F.col("last") + GAP_SECONDS * 1_000_000 >= passed)
        still.drop("gone", "changed").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        changed = now.where("changed")
        fields = [f.strip().split(" ") for f in CLUSTER.split(",")]
        back = changed.select(*KEYS, F.explode("gone").alias("g")).select(*KEYS, *[(F.col(f"g.{n}") if n in ("first", "last", "transition") else F.lit(None).cast(kind)).alias(n) for n, kind in fields])
        land_changes(changed.drop("gone", "changed").withColumn("taken_back", F.lit(False)).unionByName(back.withColumn("taken_back", F.lit(True))), lake, ingested_at)
    for n, path in kept.items():  # a batch that is repeated needs the one before it; later ones are of a stream that was begun anew
        if n not in (before, number):
            files.delete(spark, path)


def land_changes(batch: DataFrame, lake: Lake, ingested_at: Column) -> None:
    """Apply a batch of changes to the months they touch: views taken back go, new ones come. Repeating it does no harm."""
    at = lambda c: F.timestamp_micros(F.col(c))
    views = batch.withColumns({"started_at_utc": at("first"), "ended_at_utc": at("last"), "synced_at_utc": at("synced")})
    views = view_columns(views, ingested_at, "taken_back")
    with staged(views, lake) as held:
        months = {(r["y"], r["m"]) for r in held.select(F.year("started_at_utc").alias("y"), F.month("started_at_utc").alias("m")).distinct().collect()}
        if not months:
            return
        stored = lake.read(NAME, "compacted")
        new = held.where("NOT taken_back").drop("taken_back")
        if stored is not None:
            touched = stored.where(F.array_contains(F.lit([y * 12 + m for y, m in months]), F.col("year") * 12 + F.col("month")))
            kept = conform(touched, new.schema).join(held.select("page_view_id"), "page_view_id", "left_anti")
            new = new.unionByName(kept)
        with staged(new, lake) as whole:
            sinks.replace_months(whole, lake, NAME, months)


def page_view_stream(payloads: DataFrame, lake: Lake, ingested_at: Column, lateness: str = "1 day") -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    """(visits, work) of a stream of payloads (a column ``value`` of JSON text): run the visits with ``streams.run_available(..., work, "update")``."""
    good, _ = parse_payloads(payloads)
    return visits(good), lambda batch, number: land_visits(batch, number, lake, ingested_at, lateness)


def payload_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of files with one JSON payload a line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
