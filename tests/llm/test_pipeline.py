"""The pipeline, its stages on awkward inputs, and the registered queries."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from dayloom.llm import registry
from tests.conftest import DATA
from tests.llm.helpers import awkward, clashing, empty


def test_stages_in_order_on_awkward_documents(spark, tmp_path):
    docs = clashing(awkward(spark))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if name != "pack_sequences":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, empty(spark), DATA).count() == 0


def test_near_copies_and_repeats_go_and_clean_documents_stay(spark):
    docs = awkward(spark)
    texts = lambda df: [r["text"] for r in df.collect()]
    assert "1234 !!!" not in texts(corpus_pipeline.language_id(spark, docs, DATA))
    near = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sum(r["doc_id"] in (1, 2, 12, None) and r["text"].lower() == texts(docs)[0] for r in near.collect() if r["text"]) == 1
    cut = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, docs, DATA).collect()}
    assert 2 not in cut and cut[4]["text"] == texts(docs)[3] and len(cut[5]["text"].split()) == 50


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "bin", "block", "start", "size"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n != "pipeline"))
def test_queries(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    if name not in registry.ORACLE_SQL:
        return
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    wanted = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
