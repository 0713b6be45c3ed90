"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document is expected ``rate`` = target / source size times, so the prefix sum of expected
copies is rank times rate, and a document is emitted once for each integer boundary that its step crosses after one
random offset per source. Documents are ranked by (size class, hash block, size, hash): neighbours have like sizes,
so the words taken come close to the target.

Documents of over a ``LARGE``-th of their source, of which there are fewer than ``LARGE``, are dealt with first, the largest first: each is emitted as often as brings the words
taken nearest to those due so far (the same boundary crossing, in words). What is then due from the rest sets their rate, and of ``OFFSETS`` random offsets
a source takes the one that comes closest, which one more pass of sums tells.

The rank needs no sort of a whole source: documents fall into cells (source, size class, block of hashes), cells are
counted with partial aggregation, and two prefix sums over the counts (blocks within a class, classes within a
source) give each cell's first rank. Only a cell, about ``CELL_ROWS`` rows at most, is sorted in one task, so a source that
holds a third of all rows is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import materialize, seal, table, unseal, word_count

CELL_ROWS = 4_000
SEED = 42
OFFSETS = 16  # random offsets that a source can choose from
LARGE = 100
MAX_RATE = 3.0


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per source with its size, weight and target.

    Sources by code point (null last) weigh 1, 2, 3, repeating. All sizes are shared by weight, but a target stops at
    ``max_rate`` times its source's size and the excess is shared again among the rest. That ends where the
    targets are min(cap, level * weight), so the level follows from prefix sums over sources ordered by cap per weight.
    The window without a partition holds one row per source, not per document.
    """
    everything = Window.orderBy(F.asc_nulls_last(source))
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    per = per.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(max_rate))
    order = [F.asc(F.col("_cap") / F.col("weight")), F.asc_nulls_last(source)]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "_level": (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    # the first source, in this order, whose cap is not reached: its level is that of all sources after it
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(whole)
    target = F.coalesce(F.least(F.col("_cap"), level["_level"] * F.col("weight")), F.col("_cap"))
    return per.select(source, "source_size", "weight", target.alias("target"))


def size_class(size: Column) -> Column:
    """Classes of sizes, 8 to each doubling: 6 to 12 % wide, and single sizes below 16. Never null, so joins add no filter."""
    bits = F.length(F.bin(size))
    leading = F.call_function("shiftright", size, bits - 4).bitwiseAND(F.lit(7))
    return F.coalesce(F.when(size < 16, size).otherwise(bits * 8 + leading).cast("int"), F.lit(0))


def least_of(size_class_: Column) -> Column:
    """The least size of a class."""
    wide = (F.lit(8) + size_class_ % 8) * F.pow(F.lit(2.0), F.floor(size_class_ / 8) - 4)
    return F.when(size_class_ < 16, size_class_).otherwise(wide).cast("long")


def greedy(large: Column, rate: Column, most: int) -> Column:
    """Walk documents (size, class, block, in_cell), the largest first: (seen, taken, picks with copies); copies bring the words taken nearest to rate * words seen."""
    pick = "struct<class:int,block:int,in_cell:int,copies:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("taken"), F.array().cast(f"array<{pick}>").alias("picks"))

    def step(state: Column, x: Column) -> Column:
        due = (rate * (state["seen"] + x["size"]).cast("double") - state["taken"].cast("double")) / x["size"].cast("double")
        copies = F.least(F.lit(most).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor(due + F.lit(0.5)).cast("long")))
        this = F.struct(x["class"].alias("class"), x["block"].alias("block"), x["in_cell"].alias("in_cell"), copies.alias("copies"))
        return F.struct((state["seen"] + x["size"]).alias("seen"), (state["taken"] + copies * x["size"]).alias("taken"), F.concat(state["picks"], F.array(this)).alias("picks"))

    return F.aggregate(large, start, step)


def hashed(text: Column) -> Column:
    """60 bits of a text's MD5 as bigint; other engines can repeat it. Never null for texts that are not."""
    return F.coalesce(F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("long"), F.lit(0))


def _ranked(docs: DataFrame, text: str, source: str, key: str, max_rate: float, seed: int) -> DataFrame:
    """The sealed rows of ``docs`` with size, source_size, target, rank (in the source, from 1) and copies."""
    total = docs.count()
    cells = total // CELL_ROWS + 1
    held, at = seal(docs)
    # never null and in the sources' order, null last, so that ranking and joining deal rows alike and they are shuffled once
    known = F.coalesce(F.concat(F.lit("0"), F.col(at[source]).cast("string")), F.lit("1"))
    sized = held.withColumns({"source": known, "size": word_count(at[text]), "hash": hashed(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(at[key]).cast("string"), F.lit("")), F.coalesce(F.col(at[text]), F.lit(""))))})
    sized = sized.withColumns({"class": size_class(F.col("size")), "block": F.coalesce(F.pmod(F.col("hash"), F.lit(cells)).cast("int"), F.lit(0))})
    counts = materialize(sized.groupBy("source", "class", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), total)

    def before(n: str, over: list[str], order: str) -> Column:
        w = Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(w), F.lit(0))

    targets = source_targets(counts, "source", "words", max_rate).withColumnRenamed("source", "s2")
    per_class = counts.groupBy(F.col("source").alias("s1"), F.col("class").alias("k1")).agg(F.sum("n").alias("n1"), F.sum("words").alias("w1"))
    per_class = per_class.withColumn("class_first", before("n1", ["s1"], "k1")).join(targets, F.col("s1") == F.col("s2"))
    per_class = per_class.withColumn("large", least_of(F.col("k1")) * LARGE > F.col("source_size"))
    rest = F.sum(F.when(~F.col("large"), F.col("w1")).otherwise(F.lit(0))).over(Window.partitionBy("s1"))
    per_class = per_class.withColumn("rest", rest).select("s1", "k1", "class_first", "large", "rest", "source_size", "target")
    first = counts.select(F.col("source").alias("s"), F.col("class").alias("k"), F.col("block").alias("b"), before("n", ["source", "class"], "block").alias("block_first"))
    first = first.join(per_class, (F.col("s") == F.col("s1")) & (F.col("k") == F.col("k1")))
    first = materialize(first.select("s", "k", "b", (F.col("class_first") + F.col("block_first")).alias("first"), "large", "rest", "source_size", "target"), total)

    within = Window.partitionBy("source", "class", "block").orderBy("size", "hash", F.asc_nulls_last(at[key]))
    ranked = sized.withColumn("in_cell", F.row_number().over(within))
    placed = (F.col("source") == F.col("s")) & (F.col("class") == F.col("k")) & (F.col("block") == F.col("b"))
    # cells grow with the input, if slowly, so they are not broadcast
    slim = ranked.join(first.hint("merge"), placed).where("size > 0")
    slim = materialize(slim.select("source", "class", "block", "in_cell", "size", "hash", (F.col("first") + F.col("in_cell")).alias("rank"), "large", "rest", "source_size", "target"), total)

    # fewer than LARGE large documents of a source come together
    listed = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "hash", "class", "block", "in_cell", "size")))
    large = slim.where("large").groupBy("source", "source_size", "target").agg(listed.alias("docs"))
    large = large.select("source", greedy(F.col("docs"), F.col("target") / F.col("source_size"), int(max_rate)).alias("g"))
    large = materialize(large.select("source", "g.taken", "g.picks"), total)
    small = slim.where("NOT large").groupBy("source", "rest", "target").agg(F.count(F.lit(1)).alias("n"))
    due = small.join(large.select(F.col("source").alias("ls"), "taken"), F.col("source") == F.col("ls"), "left").withColumn("due", F.col("target") - F.coalesce("taken", F.lit(0)))
    rate = F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), F.col("due") / F.col("rest")))
    draws = due.select(F.col("source").alias("ds"), "due", rate.alias("rate"), F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))).alias("draw"))
    draws = draws.withColumn("offset", F.pmod(hashed(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.col("ds"), F.col("draw").cast("string"))), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    choices = materialize(draws.groupBy("ds", "due", "rate").agg(F.sort_array(F.collect_list(F.struct("draw", "offset"))).alias("offsets")), total)
    copies = (F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))).cast("long")
    cells = materialize(first.join(choices, F.col("s") == F.col("ds"), "left"), total)  # a row for each cell
    tried = slim.where("NOT large").join(cells.select("s", "k", "b", "due", "rate", "offsets").hint("merge"), placed).select("source", "size", "rank", "rate", "due", F.inline("offsets"))
    sums = tried.groupBy("source", "draw", "offset", "due").agg(F.sum(copies * F.col("size")).alias("taken"))
    best = sums.groupBy("source").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("due")), "draw", "offset")).alias("best"))
    best = materialize(best.select(F.col("source").alias("bs"), F.col("best.offset").alias("offset")), total)
    cells = cells.join(best, F.col("s") == F.col("bs"), "left").select("s", "k", "b", "first", "large", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("offset", F.lit(0.0)).alias("offset"))
    picks = large.select(F.col("source").alias("ps"), F.inline("picks")).select("ps", F.col("class").alias("pk"), F.col("block").alias("pb"), F.col("in_cell").alias("pi"), F.col("copies").alias("picked"))

    out = ranked.join(cells.hint("merge"), placed)
    out = out.join(picks, (F.col("source") == F.col("ps")) & (F.col("class") == F.col("pk")) & (F.col("block") == F.col("pb")) & (F.col("in_cell") == F.col("pi")), "left")
    out = out.withColumn("rank", F.col("first") + F.col("in_cell"))
    return out.withColumn("copies", F.when(F.col("large"), F.coalesce("picked", F.lit(0))).otherwise(copies).cast("long"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with size (words), source_size, target, rank (in its source, from 1) and copies (0 or more).

    The sum of copies * size over a source comes near its target: large documents are balanced one by one, and the rest take the closest of ``OFFSETS`` random offsets. Reruns agree: rank and offset depend on values
    alone. Null texts have size 0; a null source is a source of its own; null or repeated keys and repeated rows
    each count and are told apart by rank; an empty table gives none. All columns of ``docs`` pass through; a new
    column whose name is taken gets an underscore.
    """
    out = _ranked(docs, text, source, key, max_rate, seed)
    return unseal(out, docs.columns, **{c: F.col(c) for c in ("size", "source_size", "target", "rank", "copies")})


def emit(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix`` gives it copies, with the columns of ``docs`` alone."""
    out = _ranked(docs, text, source, key, max_rate, seed).where("copies > 0")
    return unseal(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op6_mix_sources": op6_mix_sources}
ORACLE_SQL = {
    "op6_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
        k AS (SELECT d.*, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS class,
                     h % ((SELECT count(*) FROM d) // 4000 + 1) AS block FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, block, size, h, doc_id NULLS LAST) AS rank FROM k),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * CAST(3 AS DOUBLE) AS cap FROM s),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level FROM w
              WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, coalesce(least(cap, (SELECT min(struct_pack(a := cap / weight, b := level)).b FROM l WHERE level * weight <= cap) * weight), cap) AS target FROM l),
        c AS (SELECT r.*, t.source_size, t.target,
                     CASE WHEN r.class < 16 THEN r.class ELSE CAST((8 + r.class % 8) * pow(2, r.class // 8 - 4) AS BIGINT) END * 100 > t.source_size AS large
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
        g AS (SELECT source, list_reduce(list_transform(list(struct_pack(size := size, id := rank) ORDER BY size DESC, h, class, block, rank), lambda x: struct_pack(size := x.size, id := x.id, rate := rate, seen := CAST(0 AS BIGINT), taken := CAST(0 AS BIGINT), picks := CAST([] AS STRUCT(id BIGINT, n BIGINT)[]))),
                     lambda a, x: struct_pack(size := x.size, id := x.id, rate := x.rate, seen := a.seen + x.size,
                         taken := a.taken + x.size * least(3, greatest(0, CAST(floor((x.rate * CAST(a.seen + x.size AS DOUBLE) - CAST(a.taken AS DOUBLE)) / CAST(x.size AS DOUBLE) + 0.5) AS BIGINT))),
                         picks := list_append(a.picks, struct_pack(id := x.id, n := least(3, greatest(0, CAST(floor((x.rate * CAST(a.seen + x.size AS DOUBLE) - CAST(a.taken AS DOUBLE)) / CAST(x.size AS DOUBLE) + 0.5) AS BIGINT)))))),
                     struct_pack(size := CAST(0 AS BIGINT), id := CAST(0 AS BIGINT), rate := rate, seen := CAST(0 AS BIGINT), taken := CAST(0 AS BIGINT), picks := CAST([] AS STRUCT(id BIGINT, n BIGINT)[]))) AS state
              FROM (SELECT *, target / source_size AS rate FROM c WHERE large AND size > 0) GROUP BY source, rate),
        p AS (SELECT source, unnest(state.picks) AS pick FROM g),
        q AS (SELECT c.source, target - coalesce(any_value(g.state.taken), 0) AS due, least(3.0::DOUBLE, greatest(0.0::DOUBLE, (target - coalesce(any_value(g.state.taken), 0)) / sum(c.size))) AS rate
              FROM c LEFT JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE NOT c.large AND c.size > 0 GROUP BY c.source, target),
        o AS (SELECT q.*, draw, CAST(CAST('0x' || substr(md5('42:offset:' || coalesce('0' || source, '1') || ':' || draw), 1, 15) AS BIGINT) % 1048576 AS DOUBLE) / 1048576 AS u FROM q, range(16) AS d(draw)),
        x AS (SELECT c.source, o.draw, o.u, o.due, sum(c.size * CAST(floor(c.rank * o.rate + o.u) - floor((c.rank - 1) * o.rate + o.u) AS BIGINT)) AS taken
              FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source WHERE c.size > 0 AND NOT c.large GROUP BY ALL),
        b AS (SELECT source, min(struct_pack(a := abs(taken - due), d := draw, u := u)).u AS u FROM x GROUP BY source),
        e AS (SELECT c.*, CASE WHEN c.large THEN coalesce(p.pick.n, 0) ELSE CAST(floor(c.rank * coalesce(q.rate, 0) + coalesce(b.u, 0)) - floor((c.rank - 1) * coalesce(q.rate, 0) + coalesce(b.u, 0)) AS BIGINT) END AS copies
              FROM c LEFT JOIN q ON c.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source LEFT JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.rank = p.pick.id)
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
    """
}
