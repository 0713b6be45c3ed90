"""The pipeline's language stage judges a text by itself, not by the number or shares of the languages."""

from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.helpers import DOCS


def soup(seed, letters, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(words))


@pytest.mark.parametrize("langs", [["en", "fr", "de", "es"], ["en", "fr"], ["en"]])
def test_soup_and_unlearned_scripts_go_and_learned_languages_stay(spark, langs):
    known = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("lang").isin(langs)).select(*corpus_pipeline.COLUMNS)
    odd = [soup(1, string.ascii_lowercase), soup(2, string.ascii_lowercase, 1000), soup(3, "абвгдежзийклмноп"), "漢字 仮名 文字 言語"]
    rows = [(-1 - i, t, lang, "a", len(t)) for i, t in enumerate(odd) for lang in (None, "en")]
    kept = corpus_pipeline.language_id(spark, known.unionByName(spark.createDataFrame(rows, DOCS)), DATA)
    ids = {r["doc_id"] for r in kept.collect()}
    lettered = {r["doc_id"] for r in known.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert not {i for i in ids if i < 0} and ids == lettered


def test_lettered_documents_stay_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 1), (2, "12 !!", None, "a", 1), (3, "слова", None, "a", 1)], DOCS)
    assert sorted((r["doc_id"], r["lang"]) for r in corpus_pipeline.language_id(spark, docs, DATA).collect()) == [(1, None), (3, None)]
