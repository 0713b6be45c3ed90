"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked; a cut edge is a link between shards. Every document starts in the shard of its
hash. In each round a group's documents move to the shard that holds most of the group, as far as quotas allow: a shard
admits no more linked documents than its capacity. Rounds of two kinds take turns: in one, documents move to shards that have room; in the other, two
shards swap what wishes to move from one to the other, as much either way, which needs no room. Groups larger than a fraction of a shard are dealt to pieces that
move one by one, so a group with a third of all rows fills shard after shard rather than overflow one.

Rounds work on counts per (group, piece, first shard), never on documents, and at most 40 rows a group come together. The
admission of moves compares running sums over (target, class of sizes, bucket of hashes): at most shards * SIZES * BUCKETS
rows (times shards for swaps), which bounds what is broadcast. Last, unlinked documents level the counts: each shard keeps as many rows as it is due and the rest
fill up the others, so counts differ by one at most.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import materialize, seal, table

SHARDS = 40
ROUNDS = 24  # at most; a warning tells if they end before propagation has come to rest
PIECES = 8  # of a shard's capacity: larger groups are dealt to pieces of that size
SIZES, BUCKETS = 16, 64  # classes of group sizes, and buckets of hashes in each
SALTS = 16
BLOCK_ROWS = 4_000
OVERHEAD = 16  # bytes of a document besides its text


def _values(xs: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in xs])


def _linked(rows: DataFrame, piece_rows: int) -> DataFrame:
    """(g, pieces) of groups of two rows or more, once for each salt."""
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    pieces = F.ceil(F.col("members") / F.lit(piece_rows)).cast("int")
    return groups.select("g", "members", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _round(cells: DataFrame, capacity: list[int], piece_rows: int, turn: int) -> DataFrame:
    """One round of propagation over cells (g, piece, home, label, n); a moved cell has another label. Rounds of odd ``turn`` swap."""
    swap = turn % 2 == 1
    shards = len(capacity)
    used = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    room = [capacity[s] - used.get(s, 0) for s in range(shards)]
    at = lambda xs, i: F.get(_values(xs), F.col(i))

    per = cells.groupBy("g", "label").agg(F.sum("n").alias("held"), F.max("members").alias("members"))
    coming = F.when(F.col("members") <= piece_rows, F.col("members") - F.col("held")).otherwise(F.lit(piece_rows))  # a large group comes by pieces
    open_ = F.lit(True) if swap else at(room, "label") >= coming
    tie = F.xxhash64("g", "label")  # spreads groups that two shards hold alike
    best = per.groupBy("g").agg(F.max(F.when(open_, F.struct("held", tie.alias("tie"), "label"))).alias("best")).where("best IS NOT NULL")
    targets = per.join(best, "g").where(F.struct("best.held", "best.tie") > F.struct("held", tie))
    targets = targets.select(F.col("g").alias("tg"), F.col("label").alias("tl"), F.col("best.label").alias("target"))
    wish = cells.join(targets, (F.col("g") == F.col("tg")) & (F.col("label") == F.col("tl")), "left").drop("tg", "tl")
    # small groups are admitted first, since they meet wherever they fit; within a class of sizes hashes decide
    size = F.least(F.floor(F.log2(F.col("members").cast("double"))), F.lit(SIZES - 1)).cast("long")
    wish = wish.withColumn("bucket", size * BUCKETS + F.pmod(F.xxhash64(F.lit(turn), "g", "piece"), F.lit(BUCKETS)))

    keys = ["label", "target", "bucket"] if swap else ["target", "bucket"]
    sums = wish.where("target IS NOT NULL").groupBy(*keys).agg(F.sum("n").alias("n"))
    if swap:
        flows = sums.groupBy("label", "target").agg(F.sum("n").alias("flow"))
        back = flows.select(F.col("target").alias("label"), F.col("label").alias("target"), F.col("flow").alias("back"))
        sums = sums.join(F.broadcast(flows.join(F.broadcast(back), ["label", "target"])), ["label", "target"])  # a row for each pair of shards
        running = F.sum("n").over(Window.partitionBy("label", "target").orderBy("bucket"))
        admitted = sums.withColumn("sum", running).where(F.col("sum") <= F.least("flow", "back"))
    else:
        running = F.sum("n").over(Window.partitionBy("target").orderBy("bucket"))
        admitted = sums.withColumn("sum", running).where(F.col("sum") <= at(room, "target"))
    admitted = F.broadcast(admitted.select(*[F.col(k).alias(f"a_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"a_{k}"))
    moved = wish.join(admitted, same, "left")
    return moved.select("g", "piece", "home", F.coalesce("a_target", "label").alias("label"), "n", "members", F.col("a_target").isNotNull().alias("moved"))


def propagate(rows: DataFrame, shards: int, total: int, rounds: int) -> DataFrame:
    """``rows`` (with g, h, home) with label and linked after propagation."""
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    piece_rows = max(1, total // (shards * PIECES))
    groups = materialize(_linked(rows, piece_rows), total)
    salted = rows.withColumn("salt", F.pmod(F.shiftright("h", 7), F.lit(SALTS)).cast("int"))
    dealt = salted.join(groups, ["g", "salt"], "left").drop("salt")
    dealt = materialize(dealt.withColumn("piece", F.pmod(F.shiftright("h", 13), F.col("pieces")).cast("int")).drop("pieces"), total)
    cells = dealt.where("piece IS NOT NULL").groupBy("g", "piece", "home").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("members"))
    cells = materialize(cells.withColumn("label", F.col("home")), total)
    still = 0
    for turn in range(rounds):
        cells = materialize(_round(cells, capacity, piece_rows, turn), total)
        still = still + 1 if cells.where("moved").limit(1).isEmpty() else 0
        if still == 2:  # neither kind of round moves anything
            break
    else:
        warnings.warn(f"labels still changed after {rounds} rounds", stacklevel=2)
    last = cells.select(F.col("g").alias("cg"), F.col("piece").alias("cp"), F.col("home").alias("ch"), "label")
    out = dealt.join(last, (F.col("g") == F.col("cg")) & (F.col("piece") == F.col("cp")) & (F.col("home") == F.col("ch")), "left")
    return out.withColumns({"linked": F.col("piece").isNotNull(), "label": F.coalesce("label", "home")}).drop("cg", "cp", "ch", "piece")


def level(labelled: DataFrame, shards: int, total: int) -> DataFrame:
    """``labelled`` with shard and slot: what a shard has beyond its due, unlinked rows first, fills up the others."""
    due = [total // shards + (s < total % shards) for s in range(shards)]
    kind = F.when(F.col("linked"), 0).otherwise(1)
    rows = labelled.withColumns({"kind": kind, "block": F.pmod("h", F.lit(total // (shards * BLOCK_ROWS) + 1))})
    counts = materialize(rows.groupBy("label", "kind", "block").agg(F.count(F.lit(1)).alias("n")), total // BLOCK_ROWS)
    here = {(r["label"], r["kind"]): r["n"] for r in counts.groupBy("label", "kind").agg(F.sum("n").alias("n")).collect()}  # two rows for each shard
    held = [here.get((s, 0), 0) + here.get((s, 1), 0) for s in range(shards)]
    over, ends = [0], []
    for s in range(shards):
        over.append(over[-1] + max(0, held[s] - due[s]))
        ends.append((ends[-1] if ends else 0) + max(0, due[s] - held[s]))

    before = Window.partitionBy("label", "kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("label").alias("fl"), F.col("kind").alias("fk"), F.col("block").alias("fb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("label", "kind", "block").orderBy("h", "row_order")) - 1
    ranked = rows.withColumn("own", own).join(first, (F.col("label") == F.col("fl")) & (F.col("kind") == F.col("fk")) & (F.col("block") == F.col("fb")))
    at = lambda xs, i: F.get(_values(xs), i)
    label = F.col("label")
    rank = F.col("first") + F.col("own") + F.when(F.col("kind") == 1, at([here.get((s, 0), 0) for s in range(shards)], label)).otherwise(F.lit(0))
    ranked = ranked.withColumn("rank", rank).withColumn("stays", F.col("rank") < at(due, label))
    ranked = ranked.withColumn("spare", F.col("rank") - at(due, label) + at(over[:-1], label))
    ranked = ranked.withColumn("shard", F.when(F.col("stays"), label).otherwise(F.size(F.filter(_values(ends), lambda e: e <= F.col("spare")))).cast("int"))
    start = at([held[s] - (ends[s - 1] if s else 0) for s in range(shards)], F.col("shard"))
    return ranked.withColumn("slot", F.when(F.col("stays"), F.col("rank")).otherwise(start + F.col("spare")))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(key, size, text_crc32, shard, label, linked, slot) of every row; counts of shards differ by one at most.

    ``label`` is the shard that propagation chose, ``linked`` whether another row has the same text. A null text is linked
    with empty ones. Null or repeated keys and repeated rows each take a slot; reruns agree up to rows that are
    equal; other columns play no part; an empty table gives none.
    """
    held, at = seal(docs)
    id_, plain = F.col(at[key]), F.coalesce(F.col(at[text]), F.lit(""))
    spread = F.xxhash64(F.lit(11), id_, plain)
    rows = held.select(
        id_.alias("key"),
        id_.cast("string").alias("row_order"),
        (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"),
        F.crc32(plain.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(plain)).alias("g"),
        spread.alias("h"),
        F.pmod(F.xxhash64(F.lit(12), id_, plain), F.lit(shards)).cast("int").alias("home"),
    )
    rows = materialize(rows)
    total = rows.count()
    labelled = materialize(propagate(rows, shards, total, rounds), total)
    return level(labelled, shards, total).select("key", "size", "text_crc32", "shard", "label", "linked", "slot")


def quality(sharded: DataFrame, shards: int) -> DataFrame:
    """One row about ``shard``'s outcome, or any frame with text_crc32, size and shard: links between equal texts (pairs), the share of them that shards cut,
    and the share that hashing would cut. Texts are told apart by CRC and size, which suffices for a figure.
    """
    per = sharded.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n.cast("double") * (n - 1) / 2
    groups = per.groupBy("text_crc32", "size").agg(F.sum("n").alias("all"), F.sum(pairs(F.col("n"))).alias("kept"))
    total = groups.agg(F.sum(pairs(F.col("all"))).alias("links"), F.sum("kept").alias("kept"))
    return total.select("links", (1 - F.col("kept") / F.col("links")).alias("cut"), F.lit(1 - 1 / shards).alias("cut_by_hashing"))


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law of equal row counts."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


QUERIES = {"op9_balanced_shards": op9_balanced_shards}
