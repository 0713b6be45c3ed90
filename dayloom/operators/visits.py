"""Raw visits to page views: validation, gap clustering and picking what represents a cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.ids import UNIT_SEPARATOR, iso_micros, sha_key
from dayloom.functions.times import instant
from dayloom.sources.schemas import BROWSERS, VISIT_PAYLOAD

GAP_SECONDS = 2
#: Ranks of the ways a page is reached; the least represents a cluster.
TRANSITION_RANKS = {
    "typed": 0,
    "link": 1,
    "auto_bookmark": 2,
    "form_submit": 3,
    "reload": 4,
    "keyword": 5,
    "keyword_generated": 6,
    "manual_subframe": 7,
    "auto_subframe": 8,
}
OTHER_RANK = 999


def cluster(df: DataFrame, keys: list[str], ts: str, gap: str = f"INTERVAL {GAP_SECONDS} SECONDS") -> DataFrame:
    """``df`` with cluster_no: a row joins the cluster of the row before if it follows within the gap, bound included."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(ts).over(w)
    starts = F.when(before.isNull() | (F.col(ts) > before + F.expr(gap)), 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn("cluster_no", F.sum("_starts").over(w)).drop("_starts")


def cluster_ranges(df: DataFrame, keys: list[str], ts: str, gap: str = f"INTERVAL {GAP_SECONDS} SECONDS", width: str = "INTERVAL 1 HOUR") -> DataFrame:
    """As ``cluster``, for keys that can hold a large share of all rows: each range of ``width`` of a key's time is clustered on its own, so a hot key is many tasks.

    The ranges' edges, a row for each range that has rows, tell which first cluster goes on from the range before and how many clusters came before it. Where
    both ranges and rows are few this costs one more shuffle of edges than ``cluster``.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ranged = df.withColumn("_range", F.floor(micros / F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(width))))
    local = cluster(ranged, [*keys, "_range"], ts, gap)
    edges = local.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_range").alias("_at"))
    edges = edges.agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("cluster_no").alias("_clusters"))
    order = Window.partitionBy(*names).orderBy("_at")
    goes_on = F.coalesce(F.col("_first") <= F.lag("_last").over(order) + F.expr(gap), F.lit(False)).cast("long")
    edges = edges.withColumn("_on", goes_on)
    before = F.sum(F.col("_clusters") - F.col("_on")).over(order) - F.col("_clusters")
    edges = edges.select(*names, "_at", before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_range"], [*names, "_at"], strict=True)])
    return local.join(edges, same).withColumn("cluster_no", F.col("cluster_no") + F.col("_before")).drop("_range", *names, "_at", "_before")


def rank_of(transition: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in TRANSITION_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, transition), F.lit(OTHER_RANK))


def pick_transition(transition: Column) -> Column:
    """Aggregate: the transition of least rank, ties by name; null ones do not count."""
    return F.min(F.when(transition.isNotNull(), F.struct(rank_of(transition).alias("rank"), transition.alias("name"))))["name"]


def pick_title(title: Column, ts: Column) -> Column:
    """Aggregate: the last title that is not empty; of several at one time, the greatest."""
    return F.max(F.when(title != "", F.struct(ts.alias("at"), title.alias("title"))))["title"]


def parse_payloads(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) payloads of a column of JSON text. A payload needs a sync id, a device, a known browser, a profile, a time and visits with url and time."""
    parsed = raw.withColumn("p", F.from_json(F.col(column), VISIT_PAYLOAD, {"mode": "PERMISSIVE"}))
    filled = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    good = F.lit(True)
    for c in ("p.sync_id", "p.source_device", "p.profile"):
        good = good & filled(c)
    good = good & F.coalesce(F.col("p.browser").isin(BROWSERS), F.lit(False)) & instant(F.col("p.synced_at")).isNotNull()
    visit = lambda x: F.coalesce((F.length(x["url"]) > 0) & F.try_to_timestamp(x["visit_time"]).isNotNull(), F.lit(False))
    good = good & F.col("p.items").isNotNull() & F.coalesce(F.forall("p.items", visit), F.lit(False))
    marked = parsed.withColumn("_good", good)
    return marked.where("_good").select("p.*"), marked.where("NOT _good").select(column)


def visits(payloads: DataFrame) -> DataFrame:
    """One row for each visit of valid payloads."""
    rows = payloads.select("sync_id", "source_device", "browser", "profile", instant(F.col("synced_at")).alias("synced_at_utc"), F.inline("items"))
    return rows.withColumn("visit_time", F.try_to_timestamp("visit_time"))


def page_views(rows: DataFrame, ingested_at: Column, per_payload: bool = True) -> DataFrame:
    """Page views of visits. With ``per_payload`` clusters end at a payload's end; without, they run on across payloads."""
    keys = ["source_device", "browser", "profile", "url", *(["sync_id"] if per_payload else [])]
    found = (cluster if per_payload else cluster_ranges)(rows, keys, "visit_time").groupBy(*keys, "cluster_no")
    views = found.agg(
        *([] if per_payload else [F.min("sync_id").alias("sync_id")]),
        F.min("visit_time").alias("started_at_utc"),
        F.max("visit_time").alias("ended_at_utc"),
        pick_title(F.col("title"), F.col("visit_time")).alias("title"),
        pick_transition(F.col("transition")).alias("transition"),
        F.count(F.lit(1)).alias("visit_span_count"),
        F.max("synced_at_utc").alias("synced_at_utc"),
    )
    return view_columns(views, ingested_at)


def view_columns(views: DataFrame, ingested_at: Column, *more: str) -> DataFrame:
    """Rows of clusters as page views: with their key and in the dataset's columns, then ``more``."""
    parts = [F.col(c) for c in ("source_device", "browser", "profile", "url")]
    key = sha_key(*parts, iso_micros(F.col("started_at_utc")), iso_micros(F.col("ended_at_utc")), F.col("transition"), sep=UNIT_SEPARATOR)
    return views.select(
        "sync_id", F.concat(F.lit("browser_history_page_view_"), key).alias("page_view_id"), "started_at_utc", "ended_at_utc", "url", "title", "browser", "profile",
        "source_device", "transition", "visit_span_count", "synced_at_utc", ingested_at.alias("ingested_at_utc"), *more,
    )
