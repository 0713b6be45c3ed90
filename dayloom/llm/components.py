"""Connected components over an edge table, by alternating star contractions.

Every round runs on whole tables: minima are aggregated partially before the shuffle, and the join that hands a node's
minimum to its neighbours is salted, so a hub with a third of all edges is spread over ``SALTS`` keys; minima, which grow
with the input, are never broadcast. Each round
is written to the shared checkpoint folder; only one row (a count and a checksum) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import materialize

SALTS = 16
MAX_ROUNDS = 60


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m: the least of u and all its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = least.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.hint("merge"), (F.col("u") == F.col("w")) & (F.col("salt") == F.col("slot"))).select("u", "v", "m")


def _edges(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, root) for every node in ``edges`` (a, b: bigint, none null), root the least node it reaches.

    Loops and repeated edges do no harm; an empty table gives none. ``nodes``, if known, sizes the files of the rounds.
    Rounds grow with the logarithm of the longest chain.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = materialize(_edges(edges, F.col("a"), F.col("b")), nodes)
    seen = None
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _edges(_with_minimum(both).where(v > u), v, m)
        small = _with_minimum(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        now = materialize(_edges(small.select(F.explode(F.array(F.struct(u.alias("x"), m), F.struct(v.alias("x"), m))).alias("e")), F.col("e.x"), F.col("e.m")), nodes)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = mark
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
