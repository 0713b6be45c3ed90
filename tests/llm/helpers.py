"""Frames with the awkward cases every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def awkward(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, copies, a very long text and a hot source."""
    long_text = prose(1, 30_000)
    shared = prose(2, 80)
    rows = [
        (1, prose(10, 120), "en", "a", 1),
        (2, prose(10, 120), "en", "a", 1),
        (3, prose(10, 119) + " changed", "en", "b", 1),
        (4, prose(11, 30) + " " + shared + " " + prose(12, 30), "en", "a", 1),
        (5, prose(13, 45) + "\n" + shared + "\t" + prose(14, 5), "fr", "a", 1),
        (6, long_text, "en", "a", 1),
        (7, None, "en", "a", None),
        (8, "", "en", None, 0),
        (9, " \t\n ", None, "b", 0),
        (None, prose(10, 120), None, None, None),
        (None, prose(15, 60), "en", "c", None),
        (10, "one", "en", "c", 3),
        (10, "one", "en", "c", 3),
        (11, "Ünï çødé ☃ 漢字 текст", "fr", "c", 3),
        (12, prose(10, 120).upper(), "en", "a", 1),
        (13, "x " * 200, "en", "a", 1),
        (14, "1234 !!!", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns with names that operators use for themselves."""
    from pyspark.sql import functions as F

    names = ["c0", "size", "rank", "copies", "key", "fp", "root", "doc", "anchor", "block", "salt", "label", "shard", "slot", "n_words", "lang_pred", "tox_score", "held_out", "source_size", "row_key"]
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
