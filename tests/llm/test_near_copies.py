"""Near copies against brute force over exact 5-word Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
from dayloom.llm import near_copies, op5_simhash
from tests.conftest import DATA
from tests.llm.helpers import DOCS, awkward, clashing, empty, prose


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def greedy(rows):
    """Texts that stay when rows are read in order of key."""
    kept = []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        own = grams(r["text"])
        if all(jaccard(own, k) < 0.8 for k, _ in kept):
            kept.append((own, r["text"]))
    return kept


def changed(seed, text, n):
    r = random.Random(seed)
    words = text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_near_copies_and_keeps_what_is_under_the_similarity(spark):
    texts = []
    for i in range(40):
        base = prose(1000 + i, 300)
        texts += [base, changed(i, base, 1 + i % 6), changed(100 + i, base, 60)]  # J about 0.97 to 0.82, and far below
    hot = prose(5, 200)
    texts += [changed(200 + i, hot, i % 5) for i in range(60)]  # a group with members on both sides of 0.8
    drift = prose(6, 200)
    for i in range(12):  # like the next, not like the one after
        texts.append(drift)
        drift = changed(300 + i, drift, 3)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    got = [r["text"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()]
    assert sorted(got) == sorted(t for _, t in greedy(docs.collect()))


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = near_copies.dedup(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 10, 11, 13, 14] and ids.count(None) == 1
    assert near_copies.dedup(empty(spark)).count() == 0


def test_one_repeated_line_does_not_make_copies(spark):
    line = " ".join(f"same{i}" for i in range(9)) + "\n"
    own = [prose(2000 + i, 150) for i in range(12)]
    docs = spark.createDataFrame([(i % 12, line * 40 + own[i % 12], "en", "a", 1) for i in range(18)], DOCS)
    assert op5_simhash.near_duplicates(docs).select("component_id").distinct().count() == 1
    for dedup in (op5_simhash.dedup, near_copies.dedup):
        assert sorted(r["doc_id"] for r in dedup(docs).collect()) == list(range(12))


def tables_written(monkeypatch):
    written = []
    plain = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda *a, **k: written.append(1) or plain(*a, **k))
    return written


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    words = prose(7, 2300, vocabulary=10**6).split()
    texts = [" ".join(words[i : i + 60]) for i in range(0, 2200, 1)]  # each like the next few: 5-word similarity (56 - d) / (56 + d)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    written = tables_written(monkeypatch)
    got = sorted(r["doc_id"] for r in near_copies.dedup(docs).collect())
    assert got == list(range(0, 2200, 7)) and len(written) < 20  # 6 steps on: 50 / 62 of the shingles are shared; 7 on: 49 / 63


def test_a_bucket_of_unlike_rows_makes_no_pairs_of_all(spark, monkeypatch):
    template = prose(8, 300)
    texts = [f"{prose(3000 + i, 32, 10**6)} {template} {prose(9000 + i, 32, 10**6)}" for i in range(600)]  # about 0.7 alike
    texts += [changed(i, texts[i], 2) for i in range(0, 600, 60)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    compared = []
    plain = near_copies._confirmed
    monkeypatch.setattr(near_copies, "_confirmed", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    got = sorted(r["doc_id"] for r in near_copies.dedup(docs).collect())
    assert got == list(range(600)) and sum(compared) < 600 * 599 / 2 / 3
    assert compared[-1] <= 40  # the prefixes of unlike rows share nothing


def test_settling_in_rounds_is_settling_in_order(spark):
    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(80), 2))) for _ in range(150)})
    gone = set()
    for a, b in pairs:
        gone |= {b} if a not in gone else set()
    edges = spark.createDataFrame([((a,), (b,)) for a, b in pairs], "a struct<key: int>, b struct<key: int>")
    for limit in (0, 10, 1000):
        assert {x["p"]["key"] for x in near_copies.settle(edges, limit).collect()} == gone


def test_stage_compares_within_components_of_fingerprints(spark, monkeypatch):
    # without bands what op 5 links is still found, through a row between whose set of shingles is that of another
    base = prose(11, 1500)
    near = changed(1, base, 2)
    prints = [op5_simhash.fingerprint(t.encode()) for t in (base, near)]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    docs = spark.createDataFrame([(1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, near, "en", "a", 1), (4, prose(12, 1500), "en", "a", 1), (5, None, "en", "a", 1), (None, "", "en", "a", 1)], DOCS)
    monkeypatch.setattr(near_copies, "bands", lambda own: [])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()) == [1, 4, 5]
    rows = [(i, 1, fp) for i, fp in enumerate([0, 1, 3, 15, 15, -1])]
    nodes = spark.createDataFrame([((i,), n, fp) for i, n, fp in rows], "p struct<key: int>, n int, fp long")
    held = {}
    for r in op5_simhash.linked_nodes(nodes).collect():
        held.setdefault(r["bucket"], set()).add(r["p"]["key"])
    assert sorted(map(sorted, held.values())) == [[0, 1, 2, 3, 4], [5]]
