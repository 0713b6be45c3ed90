"""Daily rollups of events with exact, mergeable distinct counts.

Ids are numbered in a dictionary that only grows. A day's distinct ids are bitmaps of their numbers, built by Spark's bitmap aggregates, so the distinct count of a
week or a month is that of the bitmaps' union: exact, and no event is read again. A rollup is refreshed by month, with the
compaction of that month; other months stay as they are.
"""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.times import period
from dayloom.sources import files, sinks
from dayloom.sources.catalog import DATASETS, Lake

BLOCKS = 64  # of hashes, in each of which new ids are numbered on their own


@dataclass(frozen=True)
class Rollup:
    """Sums and distinct counts of a dataset by day. ``sums`` are columns that are added up, ``distinct`` columns whose different values are counted."""

    dataset: str
    sums: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()

    def folder(self, lake: Lake, part: str) -> str:
        return f"{lake.root}/rollups/{self.dataset}/{part}"


PLAYS = Rollup("spotify/plays", ("ms_played",), ("track_id",))
WATCHED = Rollup("youtube/watch_events", (), ("video_id", "channel_id"))


def _known(lake: Lake, path: str) -> DataFrame | None:
    return lake.spark.read.parquet(path) if files.matches(lake.spark, f"{path}/*") else None


def _numbers(lake: Lake, rollup: Rollup, column: str, ids: DataFrame) -> DataFrame:
    """(id, number) of all ids that were met so far; new ones are added first. Numbers are dense but for the blocks' ends."""
    folder = rollup.folder(lake, f"ids-{column}")
    known = _known(lake, folder)
    fresh = ids.where("id IS NOT NULL").distinct()
    if known is not None:
        fresh = fresh.join(known.select("id"), "id", "left_anti")
    first = (known.agg(F.max("number")).first()[0] + 1) if known is not None else 0
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS))
    in_block = F.row_number().over(Window.partitionBy("block").orderBy("id")).cast("long") - 1
    numbered = fresh.withColumn("block", block).withColumn("number", F.lit(first) + in_block * BLOCKS + F.col("block"))
    numbered.select("id", "number").write.mode("append").parquet(folder)
    return lake.spark.read.parquet(folder)


def refresh(lake: Lake, rollup: Rollup, months: list[tuple[int, int]] | None = None, layer: str = "compacted") -> list[tuple[int, int]]:
    """Compute the rollup of months (all there are by default) anew from their events; the months done."""
    months = lake.months(rollup.dataset, layer) if months is None else months
    if not months:
        return []
    time = DATASETS[rollup.dataset].time
    (y1, m1), (y2, m2) = min(months), max(months)
    days = (f"{y1}-{m1:02d}-01", f"{y2}-{m2:02d}-{monthrange(y2, m2)[1]}")
    rows = lake.scan(rollup.dataset, *days, layer).withColumn("day", F.to_date(time)).withColumns({"year": F.year("day"), "month": F.month("day")})
    rows = rows.where(F.array_contains(F.lit([y * 12 + m for y, m in months]), F.col("year") * 12 + F.col("month")))
    place = ["year", "month", "day"]
    counts = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in rollup.sums])
    _replace(counts, rollup.folder(lake, "days"))
    for column in rollup.distinct:
        numbers = _numbers(lake, rollup, column, rows.select(F.col(column).alias("id")))
        placed = rows.select(*place, F.col(column).alias("id")).distinct().join(numbers, "id")
        bits = placed.groupBy(*place, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
        _replace(bits, rollup.folder(lake, f"distinct-{column}"))
    return months


def _replace(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(folder)


def stats(lake: Lake, rollup: Rollup, start: str, end: str, granularity: str) -> DataFrame:
    """period, n, the sums, and for each distinct column ``unique_<column>``, of the days from ``start`` to ``end``; only rollups are read."""
    label = period(F.col("day"), granularity)
    a, b = (int(x[:4]) * 12 + int(x[5:7]) for x in (start, end))

    def part(name: str) -> DataFrame:
        rows = lake.spark.read.parquet(rollup.folder(lake, name))
        return rows.where((F.col("year") * 12 + F.col("month")).between(a, b) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    out = part("days").groupBy(label.alias("period")).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in rollup.sums])
    for column in rollup.distinct:
        merged = part(f"distinct-{column}").groupBy(label.alias("period"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        counted = merged.groupBy("period").agg(F.sum(F.bitmap_count("bitmap")).alias(f"unique_{column}"))
        out = out.join(counted, "period", "left")
    return out.fillna(0, [f"unique_{c}" for c in rollup.distinct])


def compact(lake: Lake, rollup: Rollup, months: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Compact months of the dataset and refresh their rollup from what compaction left."""
    done = sinks.compact(lake, rollup.dataset, months)
    return refresh(lake, rollup, done)
