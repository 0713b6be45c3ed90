"""Alignment of two tokenizers' tokens by their bytes: groups, links and how often the corpus links two ids.

A byte-level BPE (A) encodes a space and the text, a piece model with byte fallback (B) the text, to which it adds the
space itself. A dangling-suffix transducer walks both token sequences: its state is the side that leads and the bytes of
it that the other has not matched yet. The other side's next token either eats into that residual or runs past it and takes the
lead; a residual that becomes empty closes a group. Steps are memoised by state and token, so bytes are compared once for each kind of step.

The counts of linked id pairs cover the whole corpus. Each text sends its distinct pairs with their numbers; pairs are summed
with partial aggregates, and the counts return by a join in which pairs with over a 10,000th of all rows, of which there are fewer than
10,000 at any size, are broadcast, so that a pair that is in every text is no hot key.

The vocabulary files are read on every node from the paths given; they are not shipped.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayloom.llm.common import hot_join, map_arrow, materialize, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# fixed value: how the byte-level vocabulary's texts are cut before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 500_000  # characters from which the JSON's own library encodes a text; the rank encoder fails on runs of a million spaces
MEMO = 1_000_000  # steps kept by a transducer
BATCH = 1 << 20  # tokens to a batch that leaves a task
SHIFT = 20  # bits of an id in a pair


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    """What a piece stands for: <0xHH> is a byte, U+2581 a space."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes.fromhex(piece[3:5])
    return piece.replace("▁", " ").encode()


class ByteTokens:
    """The byte-level BPE of a tokenizer JSON. ``known`` has each id's bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_alphabet()
        self.known = {i: bytes(byte[c] for c in token) for token, i in model["vocab"].items()}
        # ids in the order of merges are ranks, so the faster encoder gives the same ids
        self.ranks = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.known.items()}, special_tokens={})
        self.path, self.own = path, None

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.ranks.encode_ordinary(text)
        if self.own is None:
            self.own = Tokenizer.from_file(self.path)
            self.own.encode_special_tokens = True
        return self.own.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A piece model. ``known`` has each id's bytes."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = {i: piece_bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())}

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Transducer:
    """Steps from one state to the next: a state is the side that leads and its unmatched bytes, state 0 neither.

    In state 0 and where B leads, A's next token is taken; where A leads, B's. A token that contradicts the residual leads to state -1.
    """

    def __init__(self, known_a: dict[int, bytes], known_b: dict[int, bytes], memo: int = MEMO) -> None:
        self.known = (known_a, known_b)
        self.memo = memo
        self.forget()

    def forget(self) -> None:
        self.states = [(False, b"")]  # whether A leads, and what of it is not matched
        self.number = {(False, b""): 0, (True, b""): 0}
        self.step: dict[int, int] = {}
        self.single: dict[int, str] = {}  # two steps from state 0 and back, by one token of each side: the group's text

    def learn(self, state: int, token: int) -> int:
        """The next state, worked out from the bytes and kept."""
        a_leads, residual = self.states[state]
        new = self.known[a_leads][token]
        shared = min(len(residual), len(new))
        if residual[:shared] != new[:shared]:
            found = -1
        else:
            # what is left of the residual still leads; else the token's own rest does
            left = (a_leads, residual[shared:]) if len(residual) > shared else (not a_leads, new[shared:])
            found = self.number.setdefault(left, len(self.states))
            if found == len(self.states):
                self.states.append(left)
        self.step[state << SHIFT | token] = found
        return found

    def groups(self, a: list[int], b: list[int]) -> list[str] | None:
        """Each group as ``a1,a2|b1``; None if the bytes differ."""
        if len(self.step) + len(self.single) > self.memo:
            self.forget()
        single, texts = self.single.get, []
        add, ahead_a, ahead_b = texts.append, iter(a), iter(b)
        for x in ahead_a:
            y = next(ahead_b, None)
            if y is None:
                return None
            text = single(x << SHIFT | y)
            if text is None:
                group = self.walk(x, y, ahead_a, ahead_b)
                if group is None:
                    return None
                text = f"{','.join(map(str, group[0]))}|{','.join(map(str, group[1]))}"
                if len(group[0]) == len(group[1]) == 1:
                    self.single[x << SHIFT | y] = text
            add(text)
        return texts if next(ahead_b, None) is None else None

    def walk(self, x: int, y: int, ahead_a: Iterator[int], ahead_b: Iterator[int]) -> tuple[list[int], list[int]] | None:
        """From state 0, with a first token of each side, to state 0 again: the tokens of the group; None if one side ends or bytes differ."""
        taken = ([x], [y])
        state = self.next_state(self.next_state(0, x), y)
        while state > 0:
            a_leads = self.states[state][0]
            token = next(ahead_b if a_leads else ahead_a, None)
            if token is None:
                return None
            taken[a_leads].append(token)
            state = self.next_state(state, token)
        return taken if state == 0 else None

    def next_state(self, state: int, token: int) -> int:
        found = self.step.get(state << SHIFT | token)
        return self.learn(state, token) if found is None else found


class Aligner:
    """Both tokenizers and the transducer of a task."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.walk = Transducer(self.a.known, self.b.known)

    def align(self, raw: bytes | None) -> tuple[int, int, list[str]]:
        """Numbers of A's and B's tokens and the groups; none where the text is empty or the bytes do not agree with it."""
        if not raw:
            return 0, 0, []
        text = raw.decode("utf-8", "replace")
        a, b = self.a.encode(" " + text), self.b.encode(text)
        found = self.walk.groups(a, b)
        if found is None or b"".join(map(self.a.known.__getitem__, a)) != b" " + raw:
            return 0, 0, []
        return len(a), len(b), found


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)  # once for each Python worker


@lru_cache(maxsize=1 << 16)
def link_of(group: str) -> int:
    """The pair of a group's last tokens, which end together."""
    a, b = group.split("|")
    return int(a.rpartition(",")[2]) << SHIFT | int(b.rpartition(",")[2])


def ids_of(group: str) -> dict[str, list[int]]:
    a, b = group.split("|")
    return {"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))}


FIELDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
SCHEMA = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, times array<int>"
GROUPS = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))


def alignments(df: DataFrame, key: str, text: str, path_a: str = BYTE_BPE, path_b: str = PIECES, keep_groups: bool = False) -> DataFrame:
    """``key``, n_a, n_b, n_groups, groups_sha256, pairs, times and with ``keep_groups`` groups, an array of (a, b): the ids of each group.

    ``pairs`` are the distinct id pairs (a << 20 | b) whose tokens end together, one to a group, and ``times`` their numbers in the text. Texts that are null,
    empty or not spelt alike by both tokenizers have no tokens: zeros, an empty text as digest, empty arrays. Whole texts are encoded, however
    long; equal texts give equal rows; null and repeated keys count each; other columns, whatever their names, play no part; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        kinds = FIELDS | ({"groups": GROUPS} if keep_groups else {})
        for batch in batches:
            keys, texts = batch.column(0), pc.cast(batch.column(1), pa.binary())
            columns: dict[str, list] = {k: [] for k in kinds}
            first, tokens = 0, 0
            for at in range(batch.num_rows):
                n_a, n_b, groups = both.align(texts[at].as_py())
                linked: Counter[int] = Counter()
                for group, times in Counter(groups).items():
                    linked[link_of(group)] += times
                order = sorted(linked)
                digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
                values = [n_a, n_b, len(groups), digest, order, [linked[p] for p in order]]
                if keep_groups:
                    values.append(list(map(ids_of, groups)))
                for column, value in zip(columns.values(), values, strict=True):
                    column.append(value)
                tokens += n_a
                if tokens > BATCH or at == batch.num_rows - 1:
                    arrays = [pa.array(v, kind) for v, kind in zip(columns.values(), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(first, at + 1 - first), *arrays], names=[key, *kinds])
                    columns = {k: [] for k in kinds}
                    first, tokens = at + 1, 0

    picked = df.select(df[key], df[text])
    kind = picked.schema[0].dataType.simpleString()
    return map_arrow(picked, run, f"`{key}` {kind}, {SCHEMA}" + (", groups array<struct<a array<int>, b array<int>>>" if keep_groups else ""))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, best, rows): how many links of the whole corpus hold each id pair linked, whether no A id is linked to
    its B id more often, and how many texts hold it. ``aligned`` is what ``alignments`` gives.
    """
    pairs = aligned.select(F.inline(F.arrays_zip("pairs", "times")).alias("pair", "n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumns({"a": F.shiftright("pair", SHIFT), "b": F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))})
    most = F.max("count").over(Window.partitionBy("b"))  # at most as many rows as A has ids
    return counts.withColumn("best", F.col("count") == most).select("pair", "a", "b", "count", "best", "rows")


def align(df: DataFrame, key: str = "doc_id", text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECES) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``df``.

    Links are token occurrences that end together; n_best counts those whose pair is the corpus's commonest for its B id, ties included, and
    count_sum adds up the corpus's counts over the links. Nulls, empty and long texts, repeats and empty tables as in ``alignments``.
    """
    aligned = materialize(alignments(df, key, text, path_a, path_b).toDF("key", *FIELDS).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(link_counts(aligned).select("pair", "count", "best", "rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    pairs = aligned.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "n"))
    met = hot_join(pairs, counts, "pair", "rows", total)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = aligned.select("row", "key", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level BPE and of a piece model line up in every document, and how common its links are in the corpus."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
