"""Best-fit packing under conflicts: bins ordered by residual carry bitmaps of their sources and duplicate clusters.

Texts are packed into bins of ``capacity`` words. A bin takes at most ``source_limit`` pieces of one source and one
piece of a duplicate cluster, so that no sequence is filled by one source or repeats itself. The bin for a piece is
the tightest one that is compatible: a successor search over bins ordered by residual starts at the first that is large
enough and goes on past bins with a conflicting bit until none conflicts.

Only (key, size, source, cluster) is shuffled, never text. Rows are dealt by hash to blocks of about ``BLOCK_ROWS``,
and each block is packed on its own, so a task's memory is bounded. Rows that are equal are numbered and the pieces of a text count each, so neither
a row that repeats nor a very long text gathers in a block; a hot source or cluster is spread over all blocks by the hash.
Bins that a block leaves emptier than ``TIGHT`` are opened again: their pieces are dealt to new blocks, which are fewer, and packed anew, until one
block holds them all or packing them again no longer helps. A table of up to ``block_rows`` pieces is one block, where the bin is the tightest of all.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import materialize, seal, ship, table, word_count

CAPACITY = 2048
SOURCE_LIMIT = 2
RUN = 10_000  # equal rows that one task numbers
BLOCK_ROWS = 2500
TIGHT = 0.97  # bins at least so full are left as a block packed them
WORTH = 0.8  # another round of packing is worth while if it has to take up at most this share of the last one's pieces


class Bins:
    """Open bins ordered by residual, with a bitmap of sources and one of clusters each."""

    def __init__(self, capacity: int, source_limit: int) -> None:
        self.capacity, self.limit = capacity, source_limit
        self.order: list[tuple[int, int]] = []  # (residual, bin) of bins with room
        self.sources: list[int] = []  # source_limit bits for each source, filled from the lowest
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``size`` words, at most the capacity."""
        full, mark = 1 << (source * self.limit + self.limit - 1), 1 << cluster
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            b = self.order[i][1]
            if not (self.sources[b] & full or self.clusters[b] & mark):
                residual = self.order.pop(i)[0]
                break
            i += 1  # the successor: the next tighter-first bin
        else:
            b, residual = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        low = source * self.limit
        held = self.sources[b] >> low & ((1 << self.limit) - 1)
        self.sources[b] |= (held + 1) << low  # unary: 0, 1, 11, 111
        self.clusters[b] |= mark
        if residual > size:
            insort(self.order, (residual - size, b))
        return b, self.capacity - residual


def pack_block(rows: pd.DataFrame, capacity: int, source_limit: int) -> pd.DataFrame:
    """Pack one block: rows (size, source, cluster, order, ...) get bin, start and fill, the words in the bin; longest first, ties by hash."""
    rows = rows.sort_values(["size", "order"], ascending=[False, True], kind="stable")
    sources = {s: i for i, s in enumerate(sorted(set(rows["source"])))}
    clusters: dict[int, int] = {}
    bins = Bins(capacity, source_limit)
    got = [bins.place(n, sources[s], clusters.setdefault(c, len(clusters))) for n, s, c in zip(rows["size"].tolist(), rows["source"], rows["cluster"].tolist(), strict=True)]
    rows = rows.assign(bin=[b for b, _ in got], start=[s for _, s in got])
    return rows.assign(fill=rows.groupby("bin")["size"].transform("sum"))


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each of the ``times`` that a row was met, numbered in ``copy``; a row met often is first cut into runs of ``RUN`` that are dealt to tasks."""
    numbered = lambda df, first, last: df.withColumn("copy", F.explode(F.sequence(first, last)))
    few = numbered(rows.where(F.col("times") <= RUN), F.lit(1).cast("long"), F.col("times"))
    runs = rows.where(F.col("times") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    runs = runs.repartition("hash", "run")
    many = numbered(runs, F.col("run") * RUN + 1, F.least(F.col("times"), (F.col("run") + 1) * RUN)).drop("run")
    return few.unionByName(many)


def _pieces(docs: DataFrame, key: str, text: str, source: str, cluster: Column | None, capacity: int) -> DataFrame:
    """(key, part, size, source, cluster, order) of every piece of every row; order is a hash that differs among equal rows and among pieces."""
    held, at = seal(docs)
    words = F.trim(F.regexp_replace(F.lower(F.col(at[text])), r"[\x20\x09-\x0D]+", " "))
    same = F.xxhash64(words) if cluster is None else F.xxhash64(cluster)
    rows = held.select(
        F.col(at[key]).alias("key"),
        word_count(at[text]).alias("words"),
        F.coalesce(F.concat(F.lit("="), F.col(at[source]).cast("string")), F.lit("")).alias("source"),
        same.alias("cluster"),
        F.xxhash64(F.lit(3), F.col(at[key]), F.col(at[text])).alias("hash"),
    )
    rows = rows.groupBy("key", "words", "source", "cluster", "hash").agg(F.count(F.lit(1)).alias("times"))
    rows = _copies(rows)
    parts = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(capacity)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    size = F.least(F.lit(capacity), F.col("words") - F.col("part").cast("long") * capacity)
    return rows.select("key", "part", size.cast("long").alias("size"), "source", "cluster", F.xxhash64("hash", "copy", "part").alias("order"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, part, size, source, block, bin, start) of every piece of every row; block and bin name a bin.

    A text longer than the capacity is cut into pieces of the capacity and a rest; pieces of one row share its cluster and so never
    share a bin. ``cluster`` defaults to a hash of the text's words in lower case, so copies that differ in case or
    spacing are kept apart. Null and empty texts take a piece of no words; a null source is a source of its own;
    null or repeated keys and repeated rows are all packed; other columns play no part; an empty table gives none. With ``block_rows`` of at least the
    number of pieces the outcome is best fit over the whole table.
    """
    ship(docs.sparkSession)
    left = materialize(_pieces(docs, key, text, source, cluster, capacity))
    columns = left.columns
    kind = left.schema["key"].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        return pack_block(block, capacity, source_limit)[[*columns, "block", "bin", "start", "fill"]]

    total, before, turn = left.count(), 0, 0
    done = None
    while True:
        blocks = total // block_rows + 1
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "order"), F.lit(blocks)) + F.lit(before))
        packed = dealt.groupBy("block").applyInPandas(run, f"key {kind}, part int, size long, source string, cluster long, order long, block long, bin long, start long, fill long")
        loose = F.col("fill") < F.lit(TIGHT * capacity)
        again = 0
        if blocks > 1:
            packed = materialize(packed, total)
            again = packed.where(loose).count()
        if not 0 < again <= WORTH * total:
            done = packed if done is None else done.unionByName(packed)
            break
        kept = packed.where(~loose)
        done = kept if done is None else done.unionByName(kept)
        left, total, before, turn = packed.where(loose).select(*columns), again, before + blocks, turn + 1
    return done.select("key", "part", "size", F.expr("CASE WHEN source = '' THEN NULL ELSE substr(source, 2) END").alias("source"), "block", "bin", "start")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin, start and size of every piece of every document."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).withColumnRenamed("key", "doc_id")


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
