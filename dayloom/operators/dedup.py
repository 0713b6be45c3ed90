"""Deduplication, merging and what is new against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sortable(df: DataFrame) -> list[Column]:
    """A total order over whole rows, by a hash, so that ties are broken alike in every run."""
    return [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).desc()]


def keep_last(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key by ``order`` (null counts as latest, as in a sort that puts it last).

    Ties and a missing order are settled by a hash of the row. A missing key column is an error.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing dedupe key columns: {', '.join(missing)}")
    by = [F.col(order).desc_nulls_first()] if order in df.columns else []
    w = Window.partitionBy(*keys).orderBy(*by, *_sortable(df))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` (null last)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *_sortable(df))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Stored rows with incoming ones in place of those with their key; rows with a null or empty key go.

    Among incoming rows of one key the last by ``sequence`` wins, or by a hash of the row.
    """
    named = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    both = stored.withColumn("_round", F.lit(0)).unionByName(incoming.withColumn("_round", F.lit(1)), allowMissingColumns=True).where(named)
    order = [F.desc("_round"), *([F.col(sequence).desc_nulls_last()] if sequence else []), *_sortable(stored)]
    w = Window.partitionBy(key).orderBy(*order)
    return both.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_round")


def existing_ids(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are neither null nor empty."""
    return df.select(key).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct()


def only_new(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet; repeats within the batch stay."""
    return incoming.join(stored.select(key), key, "left_anti")


def ingest_counts(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: rows fetched, new and already stored."""
    marked = incoming.join(stored.select(key).distinct().withColumn("_stored", F.lit(1)), key, "left")
    total, known = F.count(F.lit(1)), F.count("_stored")
    return marked.agg(total.alias("fetched"), (total - known).alias("new"), known.alias("duplicates"))
