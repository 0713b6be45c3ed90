"""Exact top-k by inner product without random access.

Vectors of integers are dealt to blocks; each block keeps one list per dimension, sorted by component. A query reads the lists
side by side, best contributions first, in stretches: geometrically longer ones up to the middle, geometrically shorter ones from there. A stretch's entries
are gathered from the lists and added to the sums of the vectors they name. What has been read gives each vector a lower and an upper bound of its score, since
unread components are worth at least the list's last contribution and at most its next one. Vectors whose upper bound falls under the floor, the k-th best lower
bound known so far, are out, and once those left are fewer than a stretch is long only their entries are read; reading stops when no more than a few are left, and
these are scored in full, ties going to the smaller id.

One floor is handed on: a first pass over one block of vectors gives each query a k-th best score to begin all blocks with. Blocks' winners meet by
query, and the best k of those stay. How many entries were read comes out with the result.

Blocks are formed by hash and pairs (query block, vector block) are worked on in one task each, so a task holds
``QUERY_BLOCK`` queries and ``VECTOR_BLOCK`` vectors whatever the input; nothing is broadcast. Every query meets every block
once, which the stated query set asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import materialize, ship, table

TOP = 10
SCALE = 1024.0
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
FINEST = 4  # the first stretch of a list is 2^-FINEST of it, as is the last
FEW = 4  # times k vectors that are scored rather than read on for
EXACT = float(1 << 53)  # sums of integers below this are exact in doubles


def quantise(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, as a double that holds an integer, whatever its magnitude; beyond doubles it is an error."""
    scaled = lambda x: x.cast("double") * F.lit(scale)
    large = lambda y: F.when(F.abs(y) == F.lit(float("inf")), F.raise_error(F.lit("a component is too large to be scaled")).cast("double")).otherwise(y)
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(EXACT), F.floor(scaled(x)).cast("double")).otherwise(large(scaled(x))))


def usable(vector: Column) -> Column:
    """Vectors that have components, none of them null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def depths(n: int) -> list[int]:
    """How far lists of ``n`` entries are read, stretch by stretch; the last is the end."""
    rising = [n >> s for s in range(FINEST, 0, -2)] + [n >> 1]
    falling = [n - (n >> s) for s in range(2, FINEST + 1)]
    return sorted({d for d in rising + falling if d > 0} | {n})


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exactly: as 64-bit integers where doubles are exact, else as Python's integers."""
    if len(vectors) and float(np.abs(vectors).max(axis=0) @ np.abs(query)) >= EXACT:
        q = [int(x) for x in query]
        return np.array([sum(int(a) * b for a, b in zip(v, q, strict=True)) for v in vectors], object)
    return (vectors @ query).astype(np.int64)


class SortedLists:
    """One block of vectors as a sorted list of each dimension, to be read from either end. ``times`` says how many equal rows a vector stands for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.times = np.ones(len(ids), np.int64) if times is None else times[order]
        rising = np.argsort(self.vectors, axis=0, kind="stable")
        values = np.take_along_axis(self.vectors, rising, axis=0)
        # a list for each dimension from its end, then one for each from its start: which vector comes at each depth, and its component
        self.order = np.ascontiguousarray(np.concatenate([rising[::-1], rising], axis=1).T)
        self.values = np.ascontiguousarray(np.concatenate([values[::-1], values], axis=1).T)
        self.place = np.empty_like(rising)  # of each vector in each list, from the start
        np.put_along_axis(self.place, rising, np.arange(len(ids))[:, None], axis=0)

    def _depths_of(self, rows: np.ndarray, dims: np.ndarray, up: np.ndarray) -> np.ndarray:
        """How deep each row lies in each list, counted from the end that is read."""
        place = self.place[np.ix_(rows, dims)]
        return np.where(up, len(self.ids) - 1 - place, place)

    def read(self, query: np.ndarray, times: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, int]:
        """(rows that can be among the best k and reach the floor, entries read).

        Lists are read side by side, from their end where the query's component is positive and from their start where it is negative, so that large
        contributions come first. Each stretch adds the contributions of its own entries alone; once fewer rows are left than the stretch is long, only
        their entries. ``low`` is what the entries read add above each list's least, so that low + the sum of leasts is a lower bound of the score.
        """
        n, dims = len(self.ids), np.flatnonzero(query)
        weight, up = query[dims], query[dims] > 0
        lists = np.where(up, dims, dims + len(query))
        least = self.values[lists, -1] * weight if n else weight
        slack = 1e-12 * float(np.abs(query) @ np.abs(self.vectors).max(axis=0)) if n else 0.0  # of sums in doubles
        low, rows, seen, done = np.zeros(n), np.flatnonzero(times > 0), 0, 0
        for depth in depths(n) if len(dims) else []:
            if times[rows].sum() <= FEW * k:
                break
            if len(rows) > depth - done:
                who = self.order[lists, done:depth]
                low += np.bincount(who.ravel(), (self.values[lists, done:depth] * weight[:, None] - least[:, None]).ravel(), n)
                seen += who.size
            else:
                at = self._depths_of(rows, dims, up)
                row, column = np.nonzero((at >= done) & (at < depth))
                worth = self.vectors[rows[row], dims[column]] * weight[column] - least[column]
                low[rows] += np.bincount(row, worth, len(rows))
                seen += len(row)
            done = depth
            following = self.values[lists, depth] * weight if depth < n else least
            if len(rows) > depth:  # what a list could still give is not to come for those that were read in it
                met = np.bincount(self.order[lists, :depth].ravel(), np.repeat(following - least, depth), n)[rows]
            else:
                met = (self._depths_of(rows, dims, up) < depth) @ (following - least)
            lower = low[rows] + least.sum()
            if len(rows) >= k:
                best = np.argpartition(-lower, k - 1)[:k]
                best = best[np.argsort(-lower[best], kind="stable")]
                floor = max(floor, lower[best[np.searchsorted(np.cumsum(times[rows[best]]), k)]] - slack)
            rows = rows[low[rows] + following.sum() - met >= floor - slack]
        return rows, seen

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, scores, entries read) for each query: the rows among the best k that can reach its floor; one row equal to it in id and vector is left out."""
        found = []
        for q, query in enumerate(queries.astype(np.float64)):
            times = self.times.copy()
            mine = np.flatnonzero(self.ids == own[q])
            times[mine[(self.vectors[mine] == query).all(axis=1)][:1]] -= 1
            rows, seen = self.read(query, times, k, -np.inf if floors is None else floors[q])
            found.append((*self.resolve(rows, query, times, k), seen))
        return found

    def resolve(self, rows: np.ndarray, query: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k of the rows that are left."""
        ids, scores = self.ids[rows], exact_scores(self.vectors[rows], query)
        best = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
        best = np.repeat(best, np.minimum(times[rows][best], k))[:k]
        return ids[best], scores[best].astype(np.int64)


def search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    lists = SortedLists(vectors["id"].to_numpy(np.int64), np.stack(vectors["v"].to_numpy()), vectors["times"].to_numpy(np.int64))
    found = lists.search(np.stack(queries["query"].to_numpy()), queries["own"].to_numpy(np.int64), k, queries["floor"].to_numpy(np.float64))
    for own, mark, answer in zip(queries["own"], queries["mark"], found, strict=True):
        yield own, mark, *answer


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Each query's best of each block that it meets: (query_id, mark, vec_id, score, entries_read), the last on a block's first row."""

    def run(_: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = list(search_block(queries, block, k)) if len(queries) and len(block) else []
        lengths = [max(1, len(f[2])) for f in found]
        none = pd.array([pd.NA], "Int64")
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array([f[0] for f in found], np.int64), lengths),
                "mark": np.repeat(np.array([f[1] for f in found], np.int64), lengths),
                "vec_id": pd.concat([pd.Series(f[2] if len(f[2]) else none, dtype="Int64") for f in found], ignore_index=True) if found else pd.Series([], dtype="Int64"),
                "score": pd.concat([pd.Series(f[3] if len(f[2]) else none, dtype="Int64") for f in found], ignore_index=True) if found else pd.Series([], dtype="Int64"),
                "entries_read": np.concatenate([[f[4]] + [0] * (n - 1) for f, n in zip(found, lengths, strict=True)]).astype(np.int64) if found else np.empty(0, np.int64),
            }
        )

    keys = ["dim", "qb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, mark long, vec_id long, score long, entries_read long")


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score, entries_read) of each query's k best rows other than its own, by integer inner product.

    ``is_query`` is an expression over ``vectors``. Null vectors and keys, empty vectors and those with null or non-finite components take
    no part; all others do, whatever their magnitude: only a score among a block's best that 64 bits cannot hold is an error. Vectors meet those of their own
    length only. Every row counts: rows that repeat a key, or are equal, are candidates each and, if queries, answered each; a
    query leaves out one row, itself. ``entries_read`` is the number of list entries that the query read in all blocks. Other
    columns play no part; an empty table gives none.
    """
    ship(vectors.sparkSession)
    marked = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = marked.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantise(F.col("v"), scale).alias("v"), "q")
    # equal rows are one row with a number, so however many there are they are no hot key
    rows = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"), F.count_if("q").alias("asked"))
    rows = materialize(rows.withColumns({"mark": F.xxhash64("v"), "dim": F.size("v")}))
    total = rows.count()
    n_vectors = total // VECTOR_BLOCK + 1
    n_queries = rows.where("asked > 0").count() // QUERY_BLOCK + 1
    mine = F.pmod(F.xxhash64("id", "mark"), F.lit(n_vectors)).cast("int")
    theirs = F.pmod(F.xxhash64(F.lit(5), "id", "mark"), F.lit(n_queries)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asked > 0").select(F.col("dim").alias("dim"), theirs.alias("qb"), F.col("id").alias("own"), F.col("mark").alias("mark"), F.col("v").alias("query"), F.lit(float("-inf")).alias("floor"))
    blocks = rows.select("dim", every(n_queries).alias("qb"), mine.alias("vb"), "id", "v", "times")
    if n_vectors > 1:  # a floor from the first block
        ahead = _met(queries.withColumn("vb", F.lit(0)), blocks.where("vb = 0"), k).where("score IS NOT NULL").groupBy("query_id", "mark")
        floors = ahead.agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("fid"), F.col("mark").alias("fmark"), "least")
        floors = materialize(floors, total)
        queries = queries.join(floors, (F.col("own") == F.col("fid")) & (F.col("mark") == F.col("fmark")), "left")
        queries = queries.withColumn("floor", F.coalesce(F.col("least").cast("double") - F.lit(0.5), "floor")).drop("fid", "fmark", "least")
    found = _met(queries.withColumn("vb", every(n_vectors)), blocks, k)
    per = Window.partitionBy("query_id", "mark").orderBy(F.desc_nulls_last("score"), "vec_id")
    read = F.sum("entries_read").over(Window.partitionBy("query_id", "mark"))
    ranked = found.withColumns({"rank": F.row_number().over(per), "entries_read": read}).where((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    asked = rows.where("asked > 1").select(F.col("id").alias("aid"), F.col("mark").alias("amark"), "asked")
    out = ranked.join(asked, (F.col("query_id") == F.col("aid")) & (F.col("mark") == F.col("amark")), "left")
    out = out.withColumn("answer", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("asked"), F.lit(1)).cast("int"))))
    return out.select("query_id", "rank", "vec_id", "score", "entries_read")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best vectors of every query, a vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0).drop("entries_read")


QUERIES = {"op7_exact_top_k": op7_exact_top_k}
ORACLE_SQL = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """
}
