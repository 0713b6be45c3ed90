"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.session import ship
from dayloom.sources.scratch import shared_dir

#: Words in the corpus contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
FILE_ROWS = 50_000  # of an intermediate table whose size is known
SLICE_BYTES = 8 << 20  # of texts that a task works on together
HOT_KEYS = 10_000  # keys that can each hold more than a 10,000th of a table's rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``; the folder may be on any Hadoop file system."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that every executor can reach, so a lost executor costs only its own tasks. With a bound on
    its ``rows`` a small table goes to few files, rather than one for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows"
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: str) -> F.Column:
    """Number of ``WORD`` matches in a text column; null counts as 0. Built-in functions only."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seal(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed c0, c1, ... by position, and the new name of each (the first, if repeated).

    An operator can then add columns of its own without clashing with whatever names the input has.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    at: dict[str, str] = {}
    for old, new in zip(df.columns, names, strict=True):
        at.setdefault(old, new)
    return df.toDF(*names), at


def unseal(df: DataFrame, columns: list[str], **extra: F.Column) -> DataFrame:
    """The sealed columns under their old names, then ``extra``; an extra name that is taken gets underscores."""
    taken = set(columns)
    out = [F.col(f"c{i}").alias(old) for i, old in enumerate(columns)]
    for name, value in extra.items():
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(value.alias(name))
    return df.select(*out)


def hot_join(left: DataFrame, right: DataFrame, keys: str | list[str], count: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each of ``keys`` and in ``count`` how many of the ``total`` rows of ``left`` have it.

    Keys with more than a 10,000th of all rows, of which there are fewer than ``HOT_KEYS`` whatever the size, are broadcast, so
    their rows stay where they are; the rest, none of them hot, meet in a merge join. Neither side may have null keys; ``count`` is left out.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = F.col(count) * HOT_KEYS > total
    many = right.where(hot).drop(count)
    met = left.join(F.broadcast(many), keys)
    rest = left.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(right.where(~hot).drop(count).hint("merge"), keys)
    return met.unionByName(rest)


def byte_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of a text or binary column each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(pc.cast(batch.column(column), pa.binary())), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package shipped to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
