"""Writers: monthly event appends, idempotent overwrites, master snapshots and raw JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.times import month_columns
from dayloom.operators.dedup import keep_last, upsert
from dayloom.sources import files, snapshots
from dayloom.sources.catalog import DATASETS, Lake, conform


def with_months(df: DataFrame, time: str) -> DataFrame:
    """``df`` with year and month of its event time; rows whose time cannot be read go."""
    return df.withColumns(month_columns(F.col(time))).where("year IS NOT NULL AND month IS NOT NULL")


def append_events(df: DataFrame, lake: Lake, name: str) -> None:
    """Add files to the raw months that the rows belong to; masters that land by month go to that of their update."""
    dataset = DATASETS[name]
    time = dataset.time or dataset.filed_by
    if time is None:
        raise ValueError(f"{name} is a snapshot and does not land by month")
    with_months(df, time).write.mode("append").partitionBy("year", "month").parquet(lake.folder(name, "raw"))


def replace_months(rows: DataFrame, lake: Lake, name: str, months: set[tuple[int, int]]) -> None:
    """Put rows in the place of what the compacted layer has of these months; a month that gets none is emptied. ``rows`` must not be read from there."""
    filed = with_months(rows, DATASETS[name].time)
    folder = lake.folder(name, "compacted")
    filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(folder)
    left = {(r["year"], r["month"]) for r in filed.select("year", "month").distinct().collect()}
    for year, month in months - left:
        for path in files.matches(lake.spark, f"{folder}/year={year}/month={month}"):
            files.delete(lake.spark, path)


def overwrite_sync(df: DataFrame, lake: Lake, name: str, sync: str) -> None:
    """Write the rows of each sync in place of what an earlier try of it wrote; other syncs stay."""
    rows = with_months(df, DATASETS[name].time).withColumn("sync", F.col(sync))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "sync").parquet(lake.folder(name, "raw"))


def write_raw_json(df: DataFrame, folder: str, day: str) -> None:
    """An audit copy as JSON lines, filed by day."""
    df.withColumn("day", F.to_date(F.col(day))).write.mode("append").partitionBy("day").json(folder)


def upsert_master(incoming: DataFrame, lake: Lake, name: str) -> None:
    """Merge rows into a master dataset, published as its next snapshot; the merge is repeated if another writer was faster."""
    dataset = DATASETS[name]
    folder = lake.folder(name)

    def merge(current: str | None) -> DataFrame:
        stored = lake.spark.read.parquet(current) if current else lake.scan(name)
        return upsert(conform(stored, dataset.schema), conform(incoming, dataset.schema), dataset.key)

    snapshots.update(lake.spark, folder, merge)


def compact(lake: Lake, name: str, months: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Rewrite months of a dataset without repeats; returns the months that had rows.

    A month goes to one file, or to more of the advisory partition size if it is larger: rows are rebalanced, so no task
    has to write a large month alone.

    All months go through one job: rows are dealt by key, the last of each key stays, and dynamic overwrite replaces
    the months that are there. Months without rows are left as they are.
    """
    dataset = DATASETS[name]
    if dataset.key is None or not (dataset.time or dataset.filed_by):
        raise ValueError(f"{name} is not compacted: it has {'no key' if dataset.key is None else 'no months'}")
    raw = lake.read(name, "raw")
    if raw is None:
        return []
    place = ["year", "month"]
    if months is not None:
        raw = raw.where(F.array_contains(F.lit([y * 12 + m for y, m in months]), F.col("year") * 12 + F.col("month")))
    known = {f.name for f in dataset.schema}
    rows = raw.select(*[c for c in raw.columns if c in known or c in place])
    kept = keep_last(rows, [*place, dataset.key], dataset.order)
    done = [(r["year"], r["month"]) for r in rows.select(*place).distinct().orderBy(*place).collect()]
    if done:
        target = lake.folder(name, "compacted")
        kept.hint("rebalance", *[F.col(c) for c in place]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(target)
    return done
