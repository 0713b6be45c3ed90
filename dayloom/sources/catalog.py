"""Datasets by name: where they lie, how months are pruned, and what they are when they are missing.

Events lie under ``<root>/<layer>/events/<dataset>/year=/month=``, masters under ``<root>/<layer>/master/<dataset>``. A scan
turns its date range into a predicate on the partition columns, so that Spark prunes months by itself and a missing
month is just empty. A missing dataset is an empty relation whose joins the optimizer removes.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayloom.functions.times import within_days
from dayloom.sources import files, schemas, snapshots


@dataclass(frozen=True)
class Dataset:
    name: str
    schema: StructType
    key: str | None
    order: str | None
    time: str | None = None  # event time, for events
    domain: str = "events"
    filed_by: str | None = None  # of masters that land by month: the time that tells the month


DATASETS = {
    d.name: d
    for d in (
        Dataset("spotify/plays", schemas.PLAYS, "play_id", "played_at_utc", "played_at_utc"),
        Dataset("spotify/tracks", schemas.TRACKS, "track_id", "updated_at", domain="master", filed_by="updated_at"),
        Dataset("spotify/artists", schemas.ARTISTS, "artist_id", "updated_at", domain="master", filed_by="updated_at"),
        Dataset("github/pull_requests", schemas.PULL_REQUESTS, "pr_event_id", "updated_at_utc", "updated_at_utc"),
        Dataset("github/commits", schemas.COMMITS, "commit_event_id", "committed_at_utc", "committed_at_utc"),
        Dataset("github/repositories", schemas.REPOSITORIES, "repo_id", "updated_at_utc", domain="master"),
        Dataset("browser_history/page_views", schemas.PAGE_VIEWS, "page_view_id", "ingested_at_utc", "started_at_utc"),
        Dataset("youtube/watch_events", schemas.WATCH_EVENTS, "watch_event_id", "ingested_at_utc", "watched_at_utc"),
        Dataset("youtube/watch_history", schemas.WATCH_HISTORY, None, None, "watched_at_utc"),
        Dataset("youtube/videos", schemas.VIDEOS, "video_id", "updated_at", domain="master"),
        Dataset("youtube/channels", schemas.CHANNELS, "channel_id", "updated_at", domain="master"),
    )
}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows of a schema, as a relation that the optimizer knows to be empty."""
    columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema)
    return spark.sql(f"SELECT {columns} WHERE 1 = 0")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones null, the rest cast, others left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


class Lake:
    """The datasets under one root; ``local`` is a mirror that is preferred month by month, for what it has."""

    def __init__(self, spark: SparkSession, root: str, local: str | None = None) -> None:
        self.spark, self.root, self.local = spark, root.rstrip("/"), local.rstrip("/") if local else None

    def folder(self, name: str, layer: str = "compacted", root: str | None = None) -> str:
        """Folder of a dataset in the ``raw`` layer (as landed, with repeats) or the ``compacted`` one."""
        return f"{root or self.root}/{'compacted/' if layer == 'compacted' else ''}{DATASETS[name].domain}/{name}"

    def _parts(self, name: str, layer: str) -> list[tuple[str, list[str]]]:
        """(folder, paths in it) that make up a dataset: months that the mirror has from there, all others from the root.

        A dataset that is not filed by month comes whole, from the mirror if it is there; of snapshots the newest counts, wherever it is.
        """
        roots = [r for r in (self.local, self.root) if r]
        folders = [self.folder(name, layer, r) for r in roots]
        found = [x for x in (snapshots.newest(self.spark, f) for f in folders) if x]
        if found:  # the newest, the mirror's if both are as new
            snapshot = max(found, key=lambda x: x[0])[1]
            return [(snapshot, [snapshot])]
        taken: set[str] = set()
        parts = []
        for f in folders:
            months = {m[len(m.split("/year=")[0]) :]: m for m in files.matches(self.spark, f"{f}/year=*/month=*")}
            mine = [path for place, path in sorted(months.items()) if place not in taken]
            taken |= set(months)
            if mine:
                parts.append((f, mine))
        if parts:
            return parts
        return next(([(f, [f])] for f in folders if files.matches(self.spark, f"{f}/*")), [])

    def read(self, name: str, layer: str) -> DataFrame | None:
        """All files of a dataset with their partition columns, missing columns null; None if there are none.

        Snapshots are published in one place, so a layer that has none of a master gives those of the other.
        """
        dataset = DATASETS[name]
        if layer != "compacted" and not (dataset.time or dataset.filed_by) and not self._parts(name, layer):
            layer = "compacted"
        frames = [x for x in (self._load(name, folder, paths) for folder, paths in self._parts(name, layer)) if x is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def _load(self, name: str, folder: str, paths: list[str]) -> DataFrame | None:
        reader = self.spark.read.option("mergeSchema", "true")
        if "/year=" not in paths[0] and DATASETS[name].domain == "master":  # one file for each entity: folders below say nothing
            reader = reader.option("recursiveFileLookup", "true")
        try:
            return reader.option("basePath", folder).parquet(*paths) if paths != [folder] else reader.parquet(folder)
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):  # a folder without any Parquet file is an empty dataset
                return None
            if "CANNOT_MERGE_SCHEMAS" in str(e):
                return self._read_apart(name, folder, paths)
            raise

    def _read_apart(self, name: str, folder: str, paths: list[str]) -> DataFrame:
        """A dataset whose files disagree on types (such as whole numbers written as doubles): each month, and in one that disagrees with itself each file, is read alone and cast."""
        parts = []
        for path in paths:
            for piece in [path], files.matches(self.spark, f"{path}/*.parquet"):
                try:
                    found = [self.spark.read.option("basePath", folder).option("mergeSchema", "true").parquet(p) for p in piece]
                    break
                except Exception as e:
                    if "CANNOT_MERGE_SCHEMAS" not in str(e):
                        raise
            for df in found:
                place = [c for c in ("year", "month") if c in df.columns]
                parts.append(conform(df, StructType([*DATASETS[name].schema.fields, *(df.schema[c] for c in place)])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def scan(self, name: str, start: str | None = None, end: str | None = None, layer: str = "compacted") -> DataFrame:
        """Rows of a dataset, of the days from ``start`` to ``end`` if given; partition columns do not show."""
        dataset = DATASETS[name]
        df = self.read(name, layer)
        if df is None:
            return empty(self.spark, dataset.schema)
        if start and end:
            if {"year", "month"} <= set(df.columns):
                a, b = date.fromisoformat(start), date.fromisoformat(end)
                months = F.col("year").cast("int") * 12 + F.col("month").cast("int")
                df = df.where(months.between(a.year * 12 + a.month, b.year * 12 + b.month))
            return conform(df, dataset.schema).where(within_days(F.col(dataset.time), start, end))
        return conform(df, dataset.schema)

    def months(self, name: str, layer: str = "raw") -> list[tuple[int, int]]:
        """(year, month) partitions of a dataset, sorted, from folder names alone."""
        paths = [p for _, found in self._parts(name, layer) for p in found if "/year=" in p]
        parts = [dict(x.split("=", 1) for x in p.split("/") if "=" in x) for p in paths]
        return sorted({(int(p["year"]), int(p["month"])) for p in parts})

    def available(self, name: str, layer: str = "compacted") -> bool:
        """Whether a dataset holds any row."""
        df = self.read(name, layer)
        return df is not None and not df.limit(1).isEmpty()

    def register_views(self, layer: str = "compacted") -> list[str]:
        """A temp view for each dataset, named with an underscore for the slash."""
        names = []
        for name in DATASETS:
            view = name.replace("/", "_")
            self.scan(name, layer=layer).createOrReplaceTempView(view)
            names.append(view)
        return names
