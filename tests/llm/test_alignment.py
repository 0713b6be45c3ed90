"""Token alignment against a plain count over byte offsets."""

from __future__ import annotations

import bisect
import collections
import hashlib
import random
from itertools import accumulate

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayloom.llm import op12_alignment as op12
from tests.conftest import DATA
from tests.llm.helpers import awkward, clashing, empty, rows

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """The contract's columns of each text, from the offsets at which tokens end."""
    one = Tokenizer.from_file(op12.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=op12.PIECES)
    byte = op12.byte_alphabet()
    known = {i: bytes(byte[c] for c in t) for t, i in one.get_vocab(with_added_tokens=False).items()}
    found = []
    for text in texts:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spelt = [[known[i] for i in a], [op12.piece_bytes(two.id_to_piece(i)) for i in b]]
        if text and any(b"".join(s) != b" " + text.encode() for s in spelt):
            a, b, spelt = [], [], [[], []]
        ends = [list(accumulate(map(len, s))) for s in spelt]
        both = sorted(set(ends[0]) & set(ends[1]))
        last = [dict(zip(e, t)) for e, t in zip(ends, (a, b))]
        links = [(last[0][e], last[1][e]) for e in both]
        members = collections.defaultdict(lambda: ([], []))
        for side, (ids, stops) in enumerate(zip((a, b), ends)):
            for t, e in zip(ids, stops):
                members[bisect.bisect_left(both, e)][side].append(str(t))
        groups = [",".join(members[k][0]) + "|" + ",".join(members[k][1]) for k in range(len(both))]
        found.append((len(a), len(b), groups, links))
    counts = collections.Counter(link for f in found for link in f[3])
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, k in found
    ]


AWKWARD = ["", None, " ", "  two  spaces ", "a▁b", "<s>x</s> <unk>", "<|endoftext|>hi", "tab\tnl\n\r\x00e", "ﬁ Ⅳ", "☃漢字", "<0x41>x", "é", "　x", "a" * 300, "it's we'll 12345 !!!???", "word " * 50, "\U0001f469‍\U0001f680 ok"]


def test_alignment_agrees_with_offsets(spark):
    r = random.Random(0)
    texts = AWKWARD + ["".join(r.choice(" aeiost,.éß中1\n") for _ in range(r.randrange(1, 120))) for _ in range(150)]
    texts += texts[:40]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = [tuple(x) for x in op12.align(docs).select("doc_id", *COLUMNS).collect()]
    wanted = [(i if i % 7 else None, *w) for i, w in enumerate(plain(texts))]
    assert collections.Counter(got) == collections.Counter(wanted)


def test_alignment_takes_anything(spark):
    docs = clashing(awkward(spark).union(awkward(spark))).withColumns({"row": F.lit("r"), "pair": F.lit("p"), "n_a": F.lit("a")})
    got = op12.align(docs)
    assert got.columns == ["doc_id", *COLUMNS] and got.count() == docs.count()
    texts = [x["text"] for x in docs.select("text").collect()]
    wanted = [(x["doc_id"], *w) for x, w in zip(docs.collect(), plain(texts))]
    assert rows(got) == sorted(map(repr, wanted))
    assert op12.align(empty(spark)).count() == 0


def test_registered_query_whole_table(spark):
    got = op12.op12_token_alignment(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    wanted = {d["doc_id"]: w for d, w in zip(docs, plain([d["text"] for d in docs]))}
    assert {x["doc_id"]: tuple(x[c] for c in COLUMNS) for x in got.collect()} == wanted


def test_groups_come_whole(spark):
    docs = spark.createDataFrame([(1, "unbelievably tokenised, isn't it?"), (2, None)], "doc_id bigint, text string")
    one, two = sorted(op12.alignments(docs, "doc_id", "text", keep_groups=True).collect(), key=lambda x: x["doc_id"])
    both = op12.aligner(op12.BYTE_BPE, op12.PIECES)
    side = lambda k, known: b"".join(known[t] for g in one["groups"] for t in g[k])
    assert side("a", both.a.known) == side("b", both.b.known) == b" unbelievably tokenised, isn't it?"
    for g in one["groups"]:
        assert b"".join(both.a.known[t] for t in g["a"]) == b"".join(both.b.known[t] for t in g["b"])
    assert two["groups"] == [] and two["groups_sha256"] == ""


def test_transducer_forgets_and_finds_differences():
    known = {0: b"ab", 1: b"c", 2: b"abc", 3: b"x", 4: b"a", 5: b"bc"}
    walk = op12.Transducer(known, known, memo=2)
    for _ in range(5):
        assert walk.groups([0, 1, 3], [2, 3]) == ["0,1|2", "3|3"]
        assert walk.groups([0, 1], [4, 5]) == ["0,1|4,5"]
        assert walk.groups([0, 1], [2, 3]) is None and walk.groups([3], [4]) is None and walk.groups([0, 1], [4]) is None
    assert walk.groups([], []) == [] and walk.groups([0], []) is None and walk.groups([], [0]) is None


def test_long_texts_are_encoded_alike():
    both = op12.aligner(op12.BYTE_BPE, op12.PIECES)
    text = "long text of words, " * 30_000
    assert len(text) > op12.LONG and both.a.encode(text) == both.a.ranks.encode_ordinary(text)
    n_a, n_b, groups = both.align((" " * 1_200_000 + "end").encode())
    assert n_a and n_b and sum(len(g.split("|")[0].split(",")) for g in groups) == n_a
    assert op12.link_of("1,2|3") == 2 << op12.SHIFT | 3
