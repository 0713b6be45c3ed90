"""Bloom filters of the keys in each data file of a dataset, so that what is new is told without reading history.

A filter is rows (file, bits, bucket, bitmap) in a small Parquet table beside the data, under a name that Spark's readers pass over: ``HASHES`` positions
of each key, marked in bitmaps of ``BUCKET`` bits by the task that reads it and merged by a built-in aggregate. A file is indexed once, after it was landed by whatever writer; one
that is not indexed yet is simply read. So a missing filter costs time, never a repeat, and filters of files that compaction replaced are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.session import ship
from dayloom.sources import files
from dayloom.sources.catalog import DATASETS, Lake

FOLDER = "_keys"
HASHES = 7
BITS_PER_KEY = 10  # with 7 hashes about 1 in 120 keys that a file lacks passes
BUCKET = 32_768  # bits of a bitmap of Spark's bitmap functions
SENT = 256  # bitmaps that leave a task at once
MOST_CHECKS = 100_000_000  # incoming keys times files; beyond, reading history costs less than asking its filters


def hashes(key: Column, bits: Column) -> tuple[Column, Column]:
    """The first of the key's places among ``bits``, and the step to the next."""
    text = key.cast("string")
    return F.pmod(F.xxhash64(text), bits).alias("one"), F.pmod(F.xxhash64(F.lit("second"), text), bits).alias("two")


def positions(key: Column, bits: Column) -> Column:
    """Array of the key's ``HASHES`` places among ``bits``, by two hashes."""
    one, two = hashes(key, bits)
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(one + i * two, bits))


def is_set(bitmap: Column, place: Column) -> Column:
    """Whether the bit at a place of a bitmap is 1."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bucket, bitmap) of the places that keys (id, bits, one, two) mark: a bitmap of each bucket that is touched, for all of a task's keys."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, bits, one, two = (c.to_numpy() for c in batch.columns)
        for i in np.unique(ids).tolist():
            mine = ids == i
            size = int(bits[mine][0])
            place = ((one[mine][:, None] + np.arange(HASHES) * two[mine][:, None]) % size).ravel()
            bitmap = held.setdefault(i, np.zeros(size // 8, np.uint8))
            np.bitwise_or.at(bitmap, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
    for i, bitmap in held.items():
        buckets = bitmap.reshape(-1, BUCKET // 8)
        touched = np.flatnonzero(buckets.any(axis=1))
        for lo in range(0, len(touched), SENT):
            some = touched[lo : lo + SENT]
            columns = [pa.array(np.full(len(some), i), pa.int32()), pa.array(some, pa.int64()), pa.array([buckets[b].tobytes() for b in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "bucket", "bitmap"])


def _names(lake: Lake, name: str, layer: str) -> list[str]:
    """Data files of a dataset, by their path below its folder."""
    folder = lake.folder(name, layer)
    found = files.matches(lake.spark, f"{folder}/year=*/month=*/*.parquet")
    return [p[p.index("/year=") + 1 :] for p in found]


def _below(path: Column) -> Column:
    return F.regexp_extract(path, r"(year=[^/]*/month=[^/]*/[^/]*)$", 1)


def _stored(lake: Lake, name: str, layer: str) -> DataFrame | None:
    folder = f"{lake.folder(name, layer)}/{FOLDER}"
    return lake.spark.read.parquet(folder) if files.matches(lake.spark, f"{folder}/*.parquet") else None


def _read(lake: Lake, name: str, layer: str, chosen: list[str]) -> DataFrame:
    """Keys of some data files."""
    folder, key = lake.folder(name, layer), DATASETS[name].key
    return lake.spark.read.schema(DATASETS[name].schema).parquet(*[f"{folder}/{f}" for f in chosen]).select(key)


def index(lake: Lake, name: str, layer: str = "raw") -> int:
    """Add filters of the data files that have none; the number of files indexed. Only those files are read, and of them the key column."""
    stored = _stored(lake, name, layer)
    known = {r["file"] for r in stored.select("file").distinct().collect()} if stored is not None else set()
    fresh = [f for f in _names(lake, name, layer) if f not in known]
    if not fresh:
        return 0
    key, spark = DATASETS[name].key, lake.spark
    rows = _read(lake, name, layer, fresh).select(_below(F.input_file_name()).alias("file"), F.col(key).alias("key")).where("key IS NOT NULL")
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    bits = (F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") * BITS_PER_KEY / BUCKET, F.lit(1.0))))) * BUCKET).cast("long")
    numbered = spark.createDataFrame(list(enumerate(fresh)), "id int, file string").join(sizes, "file", "left").select("id", "file", F.coalesce(bits, F.lit(0)).alias("bits"))
    numbered = spark.createDataFrame(numbered.collect(), numbered.schema)  # a row for each file
    # keys stay where they are read: each task marks its own in bitmaps, and only those are shuffled
    ship(spark)
    hashed = rows.join(F.broadcast(numbered), "file").select("id", "bits", *hashes(F.col("key"), F.col("bits")))
    marks = hashed.mapInArrow(lambda batches: _marked(batches), "id int, bucket long, bitmap binary")
    merged = marks.groupBy("id", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    # files whose keys are all null have nothing to find
    none = numbered.where("bits = 0").select("id", F.lit(0).cast("long").alias("bucket"), F.lit(b"").alias("bitmap"))
    filters = merged.unionByName(none).join(F.broadcast(numbered), "id").select("file", "bits", "bucket", "bitmap")
    filters.hint("rebalance", F.col("file"), F.col("bucket")).write.mode("append").parquet(f"{lake.folder(name, layer)}/{FOLDER}")
    return len(fresh)


def may_hold(lake: Lake, name: str, keys: DataFrame, layer: str = "raw") -> list[str]:
    """The data files that can hold one of the keys (one column): those whose filter does not rule out all, and those without a filter."""
    names = _names(lake, name, layer)
    stored = _stored(lake, name, layer)
    if stored is None or not names:
        return names
    sizes = {r["file"]: r["bits"] for r in stored.select("file", "bits").distinct().collect()}
    unknown = [f for f in names if f not in sizes]
    asked = keys.toDF("key").where("key IS NOT NULL")
    known = [f for f in names if f in sizes]
    # which of two ways costs less needs no exact count, which would hold every key
    if not known or asked.agg(F.approx_count_distinct("key")).first()[0] * len(known) > MOST_CHECKS:
        return names
    asked = asked.distinct()
    filters = stored.join(F.broadcast(lake.spark.createDataFrame([(f,) for f in known], "file string")), "file")
    found = []
    for bits in sorted({sizes[f] for f in known} - {0}):
        # the first place alone rules most files out; the rest is asked of what is left
        same = filters.where(F.col("bits") == bits)
        left = asked.select("key", positions(F.col("key"), F.lit(bits)).alias("places")).withColumn("file", F.lit(None).cast("string"))
        for i in range(HASHES):
            at = F.get("places", F.lit(i))
            met = left.withColumnRenamed("file", "held").join(same.select("file", F.col("bucket").alias("b"), "bitmap"), F.floor(at / BUCKET) == F.col("b"))
            met = met.where(F.col("held").isNull() | (F.col("held") == F.col("file"))).where(is_set(F.col("bitmap"), F.pmod(at, F.lit(BUCKET))))
            left = met.select("key", "places", "file")
        found.append(left.select("file").distinct())
    passing = {r["file"] for r in reduce(DataFrame.unionByName, found).distinct().collect()} if found else set()
    passing |= set(unknown)
    return [f for f in names if f in passing]


def only_new(lake: Lake, name: str, incoming: DataFrame, layer: str = "raw") -> DataFrame:
    """Incoming rows whose key is not stored, as the plain anti join over all files gives them; only files that can hold a key are read. Repeats within the batch stay."""
    key = DATASETS[name].key
    chosen = may_hold(lake, name, incoming.select(key), layer)
    # history is merged: Spark takes it for small by its compressed files and would broadcast all its keys to every task
    return incoming.join(_read(lake, name, layer, chosen).hint("merge"), key, "left_anti") if chosen else incoming
