"""Whitening of embeddings by the singular values of the centred rows.

Entries become integers, so that the sums of the distinct vectors, and with them each entry's distance from the mean times n, are exact. Spark MLlib's
``computeSVD`` runs on the rows so centred; its singular values s give the variances s^2 / n. The total variance does not come from the
decomposition but from the exact squared deviations, so a share of it is right even where few components are kept.

What reaches the driver is bounded by the dimension: sums, the components and the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import map_arrow, materialize, table
from dayloom.llm.op7_topk import usable

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
DENSE = 1024  # up to this dimension all components are asked for, which MLlib solves to double precision
LEAST = 1e-10  # of the first component's variance; what is under it is no more than rounding
WHOLE = 1 << 62  # integers under this are worked on in 64 bits, others as Python's
EXACT = pa.decimal128(38, 0)


def rounded(vector: Column, scale: float = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of every entry c, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long") + F.lit(shift).cast("long"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of an Arrow column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` in 64 bits if ``bound``, the largest magnitude of what is worked out with it, allows; else as Python's integers."""
    return x.astype(np.int64) if bound < WHOLE else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def decimals(values: np.ndarray) -> pa.Array:
    """Integers as decimals of 38 digits; null beyond."""
    if values.dtype != object:
        return pa.array(values, pa.int64()).cast(EXACT)
    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], EXACT)


def totals(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], dim: int, kind: str) -> list:
    """The sums over all rows of the arrays that ``of`` gives for a batch of rows; each batch sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of(matrix(batch.column(0), dim))
            values = decimals(found) if kind != "double" else pa.array(found, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=["sums"])

    parts = map_arrow(df, run, f"sums array<{kind}>").select(F.posexplode("sums").alias("at", "part"))
    return [r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).orderBy("at").collect()]


@dataclass(frozen=True)
class Fit:
    """What whitening needs: the number of distinct vectors, their sums, and the weights of each component."""

    n: int
    sums: tuple[int, ...]
    weights: np.ndarray  # (dimension, components): unit eigenvectors over the roots of their variances
    explained: tuple[float, ...]
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return off_mean(x, self.n, self.sums)


def off_mean(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    bound = n * largest(x) + max(map(abs, sums), default=0)
    return exact(x, bound) * n - np.array(sums, np.int64 if bound < WHOLE else object)


def squares(d: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exactly."""
    d = exact(d, largest(d) ** 2 * max(1, d.shape[1]))
    return (d * d).sum(axis=1)


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Fit | None:
    """The whitening of ``vectors``, one column of arrays of ``dim`` longs; each distinct vector counts once. None without vectors or where they do not differ.

    Components whose variance is under ``LEAST`` of the first's are left out.
    """
    distinct = materialize(vectors.toDF("x").distinct())
    # a column of ones in front counts the rows in the same pass
    found = totals(distinct, lambda x: np.concatenate([[len(x)], exact(x, largest(x) * max(1, len(x))).sum(axis=0)]), dim, "decimal(38,0)")
    if not found:
        return None
    n, sums = int(found[0]), tuple(int(s) for s in found[1:])

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = off_mean(matrix(batch.column(0), dim), n, sums)
            rows = pa.FixedSizeListArray.from_arrays(pa.array((d / n).astype(np.float64).ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows, decimals(squares(d))], names=["y", "deviation"])

    centred = materialize(map_arrow(distinct, centre, "y array<double>, deviation decimal(38,0)"))
    whole = centred.agg(F.coalesce(F.try_sum("deviation").cast("double"), F.sum(F.col("deviation").cast("double")))).first()[0]
    variance = whole / n / n / n
    if not variance:
        return None
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("y").alias("y")), "y")
    asked = dim if dim <= DENSE else min(dim, components)
    svd = RowMatrix(rows, n, dim).computeSVD(asked, False, LEAST**0.5)
    values = svd.s.toArray()[:components] ** 2 / n
    weights = svd.V.toArray()[:, : len(values)] / np.sqrt(values)
    y = centred.select("y")
    means = np.array(totals(y, lambda b: (b @ weights).sum(axis=0), dim, "double")) / n

    def products(b: np.ndarray) -> np.ndarray:
        w = b @ weights - means
        return (w.T @ w).ravel()

    covariance = np.array(totals(y, products, dim, "double")).reshape(len(values), -1) / n
    error = float(np.abs(covariance - np.eye(len(values))).max())
    return Fit(n, sums, weights, tuple(float(v / variance) for v in values), error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) of every usable row: ``whitened`` has the row's coordinate on each of the leading
    components, ``explained`` their shares of the total variance; ``deviation`` is the exact sum of (n * x - S)^2 as decimal, null beyond 38 digits.

    Vectors that are null, empty or hold null or non-finite entries take no part. If lengths differ, those of the commonest length (the longest
    of several) do. Rows that repeat are answered each but fitted once; null keys pass; other columns play no part. An empty table, or one whose vectors are all the same, gives none;
    with fewer dimensions, or vectors that span fewer, there are fewer components.
    """
    rows = df.select(df[key].alias("key"), df[vector].alias("v")).where(usable(F.col("v"))).select("key", rounded(F.col("v"), scale, shift).alias("x"))
    commonest = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = commonest["dim"] if commonest else 1
    rows = rows.where(F.size("x") == dim)
    found = fit(rows.select("x"), dim, components) if commonest else None
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if found is None:
        return rows.limit(0).select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))])
    width = found.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = found.deviations(matrix(batch.column(1), dim))
            w = (d / found.n).astype(np.float64) @ found.weights
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), width).cast(pa.list_(pa.float64()))
            columns = [batch.column(0), pa.array(np.full(len(d), found.n)), decimals(squares(d)), lists(w), lists(np.tile(found.explained, (len(d), 1))), pa.array(np.full(len(d), found.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, schema)


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's coordinates on the 16 leading components, a row for each; a deviation that 64 bits cannot hold is null."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = out.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


QUERIES = {"op11_whitened_embeddings": op11_whitened_embeddings}
