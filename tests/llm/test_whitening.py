"""Whitening against a plain eigendecomposition with exact sums."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import op11_whitening as op11
from tests.conftest import DATA


def plain(vectors):
    """n, deviation of each usable vector, whitened matrix and shares, by numpy's eigh on the exact covariance."""
    good = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in good]
    fitted = sorted(set(x))
    n = len(fitted)
    sums = [sum(column) for column in zip(*fitted)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fitted])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    values, axes = values[order], axes[:, order]
    rows = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    trace = float(Fraction(sum(sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in fitted), n**3))
    return n, deviation, rows @ axes / np.sqrt(values), values / trace


def same_up_to_sign(got, wanted):
    for g, w in zip(got.T, wanted.T):
        sign = np.sign(g @ w)
        assert np.allclose(g * sign, w, atol=1e-7)


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame(list(enumerate(vectors)), f"vec_id bigint, embedding array<{kind}>")


@pytest.mark.parametrize("dim", [1, 3, 16, 40])
def test_whitening_agrees_with_eigenvectors(spark, dim):
    r = np.random.default_rng(dim)
    made = (r.normal(0, 1, (300, dim)) * 0.8 ** np.arange(dim) * 3).astype(np.float32).tolist()
    vectors = made + made[:30] + [made[0]] * 120
    n, deviation, whitened, shares = plain(vectors)
    got = sorted(op11.whiten(frame(spark, vectors).repartition(5)).collect(), key=lambda x: x["vec_id"])
    assert len(got) == len(vectors) and {x["n"] for x in got} == {n}
    assert [int(x["deviation"]) for x in got] == deviation
    same_up_to_sign(np.array([x["whitened"] for x in got]), whitened)
    assert np.allclose(got[0]["explained"], shares, rtol=1e-9) and got[0]["identity_error"] < 1e-9


def test_whitening_takes_anything(spark):
    r = np.random.default_rng(0)
    made = r.normal(0, 1, (60, 4)).tolist()
    bad = [None, [], [None] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    df = frame(spark, made + bad, "double").withColumns({c: F.lit("own") for c in ("x", "n", "v", "key", "whitened", "y")})
    n, deviation, whitened, _ = plain(made)
    got = sorted(op11.whiten(df).collect(), key=lambda x: x["vec_id"])
    assert [int(x["deviation"]) for x in got] == deviation and len(got) == 60
    same_up_to_sign(np.array([x["whitened"] for x in got]), whitened)
    keyless = df.withColumn("vec_id", F.lit(None).cast("bigint"))
    assert op11.whiten(keyless).count() == 60
    for nothing in ([], bad[:6], [[0.5, 0.5]], [[0.5, 0.5]] * 9):
        assert op11.whiten(frame(spark, nothing)).count() == 0
    flat = frame(spark, [[float(a), float(a), 1.0] for a in range(50)], "double")
    assert {len(x["whitened"]) for x in op11.whiten(flat).collect()} == {1}


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(1)
    made = (r.normal(0, 1e12, (40, 3))).tolist()
    _, deviation, whitened, _ = plain(made)
    got = sorted(op11.whiten(frame(spark, made, "double")).collect(), key=lambda x: x["vec_id"])
    assert [int(x["deviation"]) for x in got] == deviation
    same_up_to_sign(np.array([x["whitened"] for x in got]), whitened)


def test_registered_query_whole_table(spark):
    got = op11.op11_whitened_embeddings(spark, DATA)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    n, deviation, whitened, shares = plain([v["embedding"] for v in vectors])
    rows = sorted(got.collect(), key=lambda x: (x["vec_id"], x["component"]))
    assert len(rows) == 16 * len(vectors) and {x["n"] for x in rows} == {n}
    assert [x["component"] for x in rows[:16]] == list(range(1, 17)) and [x["deviation"] for x in rows[::16]] == deviation
    same_up_to_sign(np.array([x["whitened"] for x in rows]).reshape(-1, 16), whitened)
    assert np.allclose([x["explained"] for x in rows[:16]], shares, rtol=1e-9) and rows[0]["identity_error"] < 1e-9
