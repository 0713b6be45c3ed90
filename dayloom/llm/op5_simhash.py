"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2 bits apart share a point within 1 bit of both. So each distinct fingerprint emits itself
and its 64 one-bit variants, variants are shuffled, and fingerprints that meet at a variant are linked. A variant
can be met by 65 distinct fingerprints at most, whatever the input, and only neighbours in its sorted list
are paired (all in the list are within 2 bits of each other, so that keeps the list connected).
Copies are folded before: documents with one fingerprint are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm import near_copies
from dayloom.llm.common import hot_join, map_arrow, materialize, table, unseal
from dayloom.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer; 0 for no words."""
    words = (text or b"").lower().split()  # on bytes: A-Z alone is lowered, and space and 9 to 13 alone split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    width = min(SHINGLE, len(words))
    spans = list(zip(starts, ends[width - 1 :]))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[i : i + BLOCK]], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, text_hash) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.cast(batch.column(1), pa.binary())
            fps = pa.array((fingerprint(x.as_py()) for x in raw), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], names=["key", "fp", "text_hash"])

    picked = df.select(df[key].alias("key"), df[text].alias("text"), F.xxhash64(df[text]).alias("text_hash"))
    return map_arrow(picked, run, f"key {picked.schema[0].dataType.simpleString()}, fp long, text_hash long")


def ball_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``RADIUS`` bits, enough to connect every group."""
    fp = F.col("fp")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = fps.select(fp, F.explode(F.concat(F.array(fp), flips)).alias("variant"))
    met = ball.withColumn("other", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    return met.where(F.col("other").isNotNull() & (F.bit_count(fp.bitwiseXOR(F.col("other"))) <= RADIUS)).select(fp.alias("a"), F.col("other").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, text_hash, component_id, root) of every row; component_id is the smallest key reachable.

    Null texts and texts without words have fingerprint 0 and are linked like any other. Null keys are never the
    smallest unless a component has no other. Repeated rows stay; other columns play no part; an empty table
    gives none.
    """
    prints = materialize(fingerprints(docs, key, text))
    total = prints.count()
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")), total)
    linked = components(ball_links(nodes.select("fp")), total).withColumnRenamed("node", "fp")
    linked = materialize(linked.join(nodes.hint("merge"), "fp"), total)  # fingerprints that are distinct, so no key is hot
    # a component or a fingerprint can be large: minima are aggregated before the shuffle, and what is hot is joined by broadcast
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    moved = hot_join(linked.select("fp", "root", "copies"), smallest, "root", "n", total).select("fp", "root", "component_id", "copies")
    alone = nodes.join(linked.select("fp").hint("merge"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "copies")
    classes = materialize(moved.unionByName(alone), total)
    return hot_join(prints, classes, "fp", "copies", total).select("key", "fp", "text_hash", "component_id", "root")


def linked_nodes(prints: DataFrame) -> DataFrame:
    """(bucket, p, n) of the fingerprints ``prints`` (p, n, fp): a bucket for each component."""
    prints = materialize(prints)
    total = prints.count()
    copies = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    linked = components(ball_links(copies.select("fp")), total).select(F.col("node").alias("fp"), "root")
    roots = materialize(copies.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "copies"), total)
    return materialize(hot_join(prints, roots, "fp", "copies", total).select(F.xxhash64(F.lit("component"), "root").alias("bucket"), "p", "n").distinct(), total)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY, bands: bool = False) -> DataFrame:
    """Rows in order of key (null last), then text hash, without those like one of their component kept before: of at least
    this Jaccard similarity of their distinct ``shingle``-word shingles. Members of a component that are like none stay.

    With ``bands`` rows are also compared with those of other components that share a MinHash band, since 2 bits part most rows of similarity 0.8.
    """
    total = docs.count()
    if bands:
        sketched, prints = near_copies.sketches(docs, key, text, shingle, fingerprint)
        buckets = linked_nodes(prints).unionByName(sketched.select(F.explode("bands").alias("bucket"), "p", "n"))
        nodes = sketched.select("p")
    else:
        found = near_duplicates(docs, key, text)
        buckets = materialize(found.select(F.col("root").alias("bucket"), near_copies.place(F.col("key"), F.col("text_hash")).alias("p")).distinct(), total)
        nodes = buckets.select("p")
    gone = near_copies.dropped(docs, key, text, buckets, shingle, similarity, total)
    kept, _ = near_copies.pick(docs, key, text, nodes.join(gone.hint("merge"), "p", "left_anti"))
    return unseal(kept, docs.columns)


def op5_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_near_dups": op5_simhash_near_dups}
