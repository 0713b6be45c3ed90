"""Near copies by MinHash bands, every drop confirmed by the exact Jaccard similarity of word shingles.

SimHash balls of 2 bits find few pairs of similarity 0.8, so candidates come from ``BANDS`` bands of ``BAND_ROWS`` minima: two
sets of similarity s share a band with probability 1 - (1 - s^5)^30, over 0.99999 at 0.8. Texts with the same set of shingles
are one node. The outcome is that of reading the rows in order and dropping each that is like one kept before. It takes two steps.

Groups fall first, a comparison a member: within a bucket (a band's value) the first k members, for each k of ``STARS``, are compared with those
behind them; a node that is among the first k of all its buckets and like none before it stays, what is like it goes, both leave their buckets.

What is left shares buckets with rows that are unlike, as pages of one template do. For it candidates come from prefixes instead: with
shingles in order of frequency, rarest first, two sets of similarity 0.8 share one among the first ninth of the smaller and the first fifth of the larger, so
that a common template makes no pairs. Each pair is compared once; then only edges are worked on, in rounds, and ``SETTLED`` edges or fewer in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from dayloom.llm.common import hot_join, map_arrow, materialize, seal, unseal
from dayloom.session import ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 30, 5
SEED = 42
BLOCK = 4096
SALTS = 16
STARS = (1, 4)  # members of a bucket that its others are compared with, step by step
SETTLED = 100_000  # edges that one task settles

_MIX = np.array([[xxhash.xxh64_intdigest(b"%d" % i, seed) for i in range(BANDS * BAND_ROWS)] for seed in (1, 2)], np.uint64)[:, :, None]
ADD, TIMES = _MIX[0], _MIX[1] | np.uint64(1)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than ``width`` are one shingle, no words none."""
    words = (text or b"").lower().split()  # on bytes: A-Z alone is lowered, and space and 9 to 13 alone split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(width, len(words)) - 1 :])
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """The bands' values of a set of shingles; none of an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), BLOCK):
        least = np.minimum(least, ((own[i : i + BLOCK] ^ ADD) * TIMES).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty ones are the same."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return not len(a) + len(b) or both / (len(a) + len(b) - both) >= similarity


def place(key: Column, text_hash: Column) -> Column:
    """A row's place in the order that decides what stays: by key, null last, then by text hash."""
    return F.struct(key.isNull().alias("none"), key.alias("key"), text_hash.alias("text_hash"))


def pick(docs: DataFrame, key: str, text: str, places: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The sealed row of each place in ``places`` (p), with p; of rows that are equal in both, one."""
    held, at = seal(docs)
    known = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    wanted = places.select(known(F.col("p.key")).alias("row_key"), F.col("p.text_hash").alias("row_hash"), "p")
    met = held.withColumns({"row_key": known(F.col(at[key])), "row_hash": F.xxhash64(F.col(at[text]))}).join(wanted.hint("merge"), ["row_key", "row_hash"])
    one = Window.partitionBy("row_key", "row_hash").orderBy(F.lit(0))  # dealt as the join is, so no further shuffle
    return met.withColumn("copy", F.row_number().over(one)).where("copy = 1"), at


def _sets(docs: DataFrame, key: str, text: str, places: DataFrame, width: int) -> DataFrame:
    """(p, s): the shingles of each place."""
    rows, at = pick(docs, key, text, places)
    rows = rows.select("p", F.col(at[text]).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                s = pa.array([shingles(x.as_py(), width).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), s], names=["p", "s"])

    return map_arrow(rows, run, StructType(list(rows.select("p").schema.fields)).add("s", ArrayType(LongType())))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike. A hub's set is sent once for each salt that its partners have."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hubs = salted.select("a", "salt").distinct().join(sets.select(F.col("p").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = salted.join(sets.select(F.col("p").alias("b"), F.col("s").alias("sb")).hint("merge"), "b").join(hubs.hint("merge"), ["a", "salt"]).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [alike(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64), similarity) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, both.select("a", "b").schema)


def _shared(rows: DataFrame, total: int) -> DataFrame:
    """The rows (bucket, p, ...) of buckets that hold two or more; a bucket that holds a large share of them is joined by broadcast."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return hot_join(rows, counts, "bucket", "held", total).select(*rows.columns)


def _similar_sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)


def prefix_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a before b: all pairs of ``sets`` (p, s) that can have this similarity, by shingles among the rarest of both and the places they hold there.

    Exact: a pair of this similarity is never missed. A shingle of one set alone makes no pair but takes its place in the order.
    """
    n, i = F.col("n"), F.col("i")
    up = lambda share, of: F.ceil(of * F.lit(share) - F.lit(1e-9))
    both = 2 * similarity / (1 + similarity)  # of two sets of like size
    tokens = sets.select("p", F.size("s").alias("n"), F.explode("s").alias("t"))
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).withColumn("held", F.col("c"))
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    order = Window.partitionBy("p").orderBy("held", "t")  # a set's own shingles
    ranked = hot_join(tokens, counts, "t", "c", total).withColumn("i", F.row_number().over(order))
    prefix = materialize(ranked.where((F.col("held") > 1) & (i <= n - up(similarity, n) + 1)).select("t", "p", "n", "i"))
    large = prefix.select("t", F.col("p").alias("lp"), F.col("n").alias("ln"), F.col("i").alias("li"))
    small = prefix.where(i <= n - up(both, n) + 1).select("t", F.col("p").alias("sp"), F.col("n").alias("sn"), F.col("i").alias("si"))
    met = large.join(small.hint("merge"), "t").where((F.struct("sn", "sp") < F.struct("ln", "lp")) & _similar_sizes("sn", "ln", similarity))
    # from the first shingle that a pair shares on, enough must be left on both sides
    met = met.where(1 + F.least(F.col("ln") - F.col("li"), F.col("sn") - F.col("si")) >= up(both / 2, F.col("ln") + F.col("sn")))
    return met.select(F.least("sp", "lp").alias("a"), F.greatest("sp", "lp").alias("b")).distinct()


def settle(edges: DataFrame, limit: int = SETTLED) -> DataFrame:
    """(p) of the nodes that go when nodes are taken in order and each takes away those it has an edge (a, b: a before b) to.

    In each round the nodes with nothing before them stay; once ``limit`` edges or fewer are left, one task reads them in order.
    """
    names = [f.name for f in edges.schema["a"].dataType.fields]
    gone = edges.select(F.col("b").alias("p")).limit(0)
    while edges.count() > limit:
        first = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_anti")
        out = edges.join(first.hint("merge"), "a").select("b").distinct()
        decided = materialize(first.select(F.col("a").alias("p"), F.lit(False).alias("goes")).unionByName(out.select(F.col("b").alias("p"), F.lit(True).alias("goes"))))
        gone = gone.unionByName(decided.where("goes").select("p"))
        for side in ("a", "b"):
            edges = edges.join(decided.select(F.col("p").alias(side)).hint("merge"), side, "left_anti")
        edges = materialize(edges.select("a", "b"))

    def rest(table: pa.Table) -> pa.Table:
        sides = [[tuple(x[f] for f in names) for x in table.column(c).to_pylist()] for c in ("a", "b")]
        taken: dict[tuple, int] = {}
        for at in sorted(range(len(table)), key=lambda at: sides[0][at]):
            if sides[0][at] not in taken:
                taken.setdefault(sides[1][at], at)
        return table.select(["b"]).rename_columns(["p"]).take(pa.array(sorted(taken.values()), pa.int64()))

    schema = StructType().add("p", edges.schema["b"].dataType)
    ship(edges.sparkSession)
    return gone.unionByName(edges.groupBy().applyInArrow(lambda t: rest(t), schema))


def dropped(docs: DataFrame, key: str, text: str, buckets: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, total: int | None = None) -> DataFrame:
    """(p) of the places in ``buckets`` (bucket, p: each once, and n, the number of its shingles, if known) that are like one that stays and precedes them.

    Rows that share no bucket are not compared. ``total``, if known, sizes the files. The number of tables written does not grow with chains or buckets but for ``settle``.
    """
    rows = buckets.count()
    active = materialize(_shared(buckets, rows))
    gone = active.select("p").limit(0)
    if not active.head(1):
        return gone
    sets = materialize(_sets(docs, key, text, active.select("p").distinct(), shingle))
    if "n" not in active.columns:
        active = materialize(active.join(sets.select("p", F.size("s").alias("n")).hint("merge"), "p"))
    for k in STARS:
        order = Window.partitionBy("bucket").orderBy("p")
        ranked = active.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = ranked.select(F.col("bucket").alias("own"), F.col("p").alias("a"), F.col("n").alias("an"))
        slots = first.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        members = active.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
        met = members.join(slots.hint("merge"), (F.col("bucket") == F.col("own")) & (F.col("salt") == F.col("slot")))
        met = met.where((F.col("a") < F.col("p")) & _similar_sizes("an", "n", similarity)).select("a", F.col("p").alias("b")).distinct()
        edges = materialize(_confirmed(met, sets, similarity), total)
        held = active.groupBy("p").agg(F.count(F.lit(1)).alias("all_buckets"))
        ahead = first.groupBy("a").agg(F.count(F.lit(1)).alias("those_ahead"))
        everywhere = held.join(ahead.hint("merge"), (F.col("p") == F.col("a")) & (F.col("all_buckets") == F.col("those_ahead"))).select("p")
        stay = everywhere.join(edges.select("b").hint("merge"), F.col("p") == F.col("b"), "left_anti")
        out = edges.join(stay.hint("merge"), F.col("a") == F.col("p")).select(F.col("b").alias("p")).distinct()
        decided = materialize(stay.withColumn("goes", F.lit(False)).unionByName(out.withColumn("goes", F.lit(True))), total)
        gone = gone.unionByName(decided.where("goes").select("p"))
        left = materialize(active.join(decided.select("p").hint("merge"), "p", "left_anti").select("bucket", "p", "n"))
        active = materialize(_shared(left, rows))
        if not active.head(1):
            return gone
    open_sets = sets.join(active.select("p").distinct().hint("merge"), "p", "left_semi")
    return gone.unionByName(settle(materialize(_confirmed(prefix_pairs(open_sets, similarity), sets, similarity))))


def sketches(docs: DataFrame, key: str, text: str, shingle: int, fingerprint: Callable[[bytes | None], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(p, n, bands): the first row of each set of shingles, with its size and the values of its bands; and (p, n, fp): the fingerprints that rows of its set have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, values, prints = [], [], [], []
            for x in pc.cast(batch.column(1), pa.binary()):
                own = shingles(x.as_py(), shingle)
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                values.append(bands(own))
                prints.append(fingerprint(x.as_py()) if fingerprint else None)
            made = [pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["key", "text_hash", "name", "n", "bands", "fp"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    found = materialize(map_arrow(picked, run, f"key {picked.schema[0].dataType.simpleString()}, text_hash long, name binary, n int, bands array<bigint>, fp long"))
    least = found.groupBy("name").agg(F.min(F.struct(place(F.col("key"), F.col("text_hash")).alias("p"), "n", "bands")).alias("r"))
    nodes = materialize(least.select("name", "r.p", "r.n", "r.bands"))
    prints = found.where("fp IS NOT NULL").select("name", "fp").distinct().join(nodes.select("name", "p", "n").hint("merge"), "name")
    return nodes.select("p", "n", "bands"), prints.select("p", "n", "fp")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows in order of key (null last), then text hash, without those like one kept before: of at least this Jaccard
    similarity of their distinct ``shingle``-word shingles.

    Null texts and texts without words are copies of one another. All columns pass through; an empty table gives none.
    """
    nodes, _ = sketches(docs, key, text, shingle)
    gone = dropped(docs, key, text, nodes.select(F.explode("bands").alias("bucket"), "p", "n"), shingle, similarity, docs.count())
    kept, _ = pick(docs, key, text, nodes.select("p").join(gone.hint("merge"), "p", "left_anti"))
    return unseal(kept, docs.columns)
