"""Substring dedup by difference-cover anchors.

Two equal runs of ``WINDOW`` words, wherever they start in their documents, have a pair of aligned positions that both
lie in ``COVER`` modulo ``PERIOD``. So anchors, runs of ``ANCHOR`` words, are hashed at cover positions only (6 of 31), and any
equal windows share an aligned anchor. Anchors met in one text alone are dropped after one shuffle; the rest are extended to all windows that hold them, and these are compared whole (128 bits of hash) in a second shuffle.

Exact copies are folded first: only the row of smallest key of equal texts is anchored, since a longer copy of it goes
entirely. Groups are never gathered. Anchors that a 10,000th of all anchors are equal to, as a sample of texts tells, are known to be shared and not
shuffled. A window that many texts have holds such an anchor (of n texts with a window, n / 6 at least share one of the anchors in it), and only such are salted: rows
with a smaller key in their own salt are settled there, and of the rest, one a salt, the smallest key is found in a second, small shuffle. A text sends an anchor or a window
once, however often it repeats it. Texts are shuffled once, by a hash of key and text, and that exchange serves all passes over them; those too short for a window stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import HOT_KEYS, map_arrow, seal, table, unseal

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # a perfect difference set modulo 31: every difference occurs
ANCHOR = WINDOW - PERIOD + 1
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2^64
LAST = (1 << 63) - 1  # stands for a null key: larger than any other
SHORT = 2 * WINDOW - 1  # bytes under which a text has no window
SALTS = 64
SAMPLED, OFTEN = 16, 8  # every 16th text is looked through for hot anchors, which are met there 8 times at least


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


POWERS = [Powers(b) for b in BASES]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hash of the ``width`` words from every position, by a polynomial over the words' hashes."""
    up, down = POWERS[which].get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[1:], out=sums[1:])
    out = (sums[width:] - sums[:-width]) * down[: len(hashes) - width + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out.view(np.int64)


def cover_positions(n: int) -> np.ndarray:
    """Anchor positions of a document of ``n`` words, in order."""
    every = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return every[every <= n - ANCHOR]


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, anchor hashes, word hashes)."""
    hashes = word_hashes(words)
    at = cover_positions(len(words))
    return at, run_hashes(hashes, ANCHOR, 0)[at], hashes


def once(*hashes: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct tuple of hashes."""
    if len(np.unique(hashes[0])) == len(hashes[0]):
        return np.arange(len(hashes[0]))
    return np.sort(np.unique(np.stack(hashes), axis=1, return_index=True)[1])


def candidate_windows(words: list[bytes], shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, first hash, second hash, whether they hold a hot anchor) of the windows that hold an anchor in ``shared`` or ``hot``; equal ones once, at the first."""
    at, own, hashes = anchors(words)
    warm = np.isin(own, hot)
    marks = np.zeros((2, len(words) + 2), np.int64)
    for i, hit in enumerate((at[np.isin(own, shared) | warm], at[warm])):
        np.add.at(marks[i], np.maximum(0, hit + ANCHOR - WINDOW), 1)
        np.add.at(marks[i], hit + 1, -1)
    held, warm = np.cumsum(marks, axis=1)[:, : len(words) - WINDOW + 1] > 0
    starts = np.flatnonzero(held)
    if not len(starts):
        return starts, starts, starts, warm[starts]
    w1, w2 = run_hashes(hashes, WINDOW, 0)[starts], run_hashes(hashes, WINDOW, 1)[starts]
    first = once(w1, w2)
    return starts[first], w1[first], w2[first], warm[starts][first]


def everywhere(words: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Positions of all windows equal to one of those at ``starts``."""
    hashes = word_hashes(words)
    w1, w2 = run_hashes(hashes, WINDOW, 0), run_hashes(hashes, WINDOW, 1)
    return np.flatnonzero(np.isin(w1, w1[starts]) & np.isin(w2, w2[starts]))


def removed_words(n: int, starts: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words is covered by a window at one of ``starts``."""
    change = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change)[:n] > 0


def _raw(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in pc.cast(column, pa.binary()))


def _emit_anchors(text: str, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (anchor, row, hot), each anchor once for a row; for all hot ones there is one entry, under the row's own number."""
    for batch in batches:
        found, owner, marks = [], [], []
        for row, raw in zip(batch.column("row").to_numpy(), _raw(batch.column(text))):
            words = raw.split()
            if len(words) >= WINDOW:
                own = np.unique(anchors(words)[1])
                cold = own[~np.isin(own, hot)]
                if len(cold) < len(own):
                    cold = np.append(cold, row)
                found.append(cold)
                owner.append(np.full(len(cold), row))
                marks.append(np.arange(len(cold)) == (len(cold) - 1 if len(np.intersect1d(own, hot)) else -1))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, owner, marks)], names=["anchor", "row", "hot"])


def _emit_windows(text: str, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc, text, shared) to (w1, w2, row, doc, place, warm) of candidate windows."""
    names = ["w1", "w2", "row", "doc", "place", "warm"]
    batch_of = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.bool_() if n == "warm" else pa.int64()) for n, c in zip(names, zip(*parts))], names=names)
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        held = 0
        shared = batch.column("shared")
        for i, (row, doc, raw) in enumerate(zip(batch.column("row").to_numpy(), batch.column("doc").to_numpy(), _raw(batch.column(text)))):
            words = raw.split()
            if len(words) < WINDOW:
                continue
            at, w1, w2, warm = candidate_windows(words, np.array(shared[i].values, np.int64), hot)
            parts.append([w1, w2, np.full(len(at), row), np.full(len(at), doc), at, warm])
            held += len(at)
            if held > 200_000:
                yield batch_of(parts)
                parts, held = [], 0
        if parts:
            yield batch_of(parts)


def _cut(text: str, batch: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """(words, removed words, kept text) of each row of (text, keeper, covered)."""
    n_words, n_removed, kept = [], [], []
    covered = batch.column("covered")
    for i, raw in enumerate(_raw(batch.column(text))):
        words = raw.split()
        n = len(words)
        if n < WINDOW:
            gone = np.zeros(n, bool)
        elif not batch.column("keeper")[i].is_valid:
            gone = np.ones(n, bool)  # a copy of a text with a smaller key
        else:
            starts = np.array(covered[i].values, np.int64) if covered[i].is_valid else np.empty(0, np.int64)
            gone = removed_words(n, everywhere(words, starts)) if len(starts) else np.zeros(n, bool)
        n_words.append(n)
        n_removed.append(int(gone.sum()))
        kept.append(b" ".join(words) if not n_removed[-1] else b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
    return n_words, n_removed, kept


def _earlier(windows: DataFrame) -> DataFrame:
    """(row, covered): the places of the windows (w1, w2, row, doc, place, warm) that a row with a smaller key has too."""
    same = ["w1", "w2"]
    order = lambda keys: Window.partitionBy(*keys).orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    salt = F.when(F.col("warm"), F.pmod("row", F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    # both branches read the same columns, so that they share one exchange
    met = windows.select(*same, salt.alias("salt"), "row", "doc", "place").withColumn("first", F.first("doc").over(order([*same, "salt"])))
    here = met.where("first < doc").select("row", "place")
    # of a window a row a salt is left, or the rows that share its key
    left = met.where("salt >= 0 AND first = doc").select(*same, "row", "doc", "place").withColumn("least", F.first("doc").over(order(same)))
    return here.unionByName(left.where("least < doc").select("row", "place")).groupBy("row").agg(F.collect_list("place").alias("covered"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``WINDOW`` words that covers it also starts in a row with a smaller key; windows are judged
    on the input. Null texts have no words. Null keys are larger than any other and equal to each other; rows with
    equal keys never take from each other. All columns and rows pass through; a new name that is taken gets an
    underscore; an empty table gives none. Keys are integers; others are a TypeError.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} is no integer column")
    held, at = seal(docs)
    names, body = held.columns, at[text]
    plain = F.col(body)
    doc = F.coalesce(F.col(at[key]).cast("long"), F.lit(LAST)).alias("doc")
    row = lambda of: F.xxhash64(of, "digest").alias("row")  # noqa: E731  rows that are equal in key and text share it, and their fate
    long_ = F.coalesce(F.octet_length(plain), F.lit(0)) >= SHORT
    bytes_ = held.agg(F.sum(F.octet_length(plain).cast("long"))).first()[0] or 0
    total = bytes_ // 10 + 1  # no more than five times as many words, so as many anchors
    whole = held.where(long_).select(doc, F.unhex(F.md5(plain)).alias("digest"), *names).select(row("doc"), "doc", *names)  # all passes join this very relation, with all its columns, so that the exchange is reused
    keepers = held.where(long_).select(doc, F.unhex(F.md5(plain)).alias("digest")).groupBy("digest").agg(F.min("doc").alias("doc")).select(row("doc"), F.lit(True).alias("keeper")).hint("merge")  # merge joins throughout: a broadcast would spare one pass the exchange, and cost the others theirs

    kept = whole.join(keepers, "row")
    some = map_arrow(whole.where(F.pmod("row", F.lit(SAMPLED)) == 0).select("row", body), partial(_emit_anchors, body, np.empty(0, np.int64)), "anchor long, row long, hot boolean")
    often = some.distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    hot = np.array([r["anchor"] for r in often.where(F.col("n") * HOT_KEYS * SAMPLED > total).collect()], np.int64)  # fewer than 5 * HOT_KEYS

    found = map_arrow(kept, partial(_emit_anchors, body, hot), "anchor long, row long, hot boolean")
    meet = Window.partitionBy("anchor").orderBy("row")
    shared = found.withColumns({"before": F.lag("row").over(meet), "after": F.lead("row").over(meet)})
    shared = shared.where("hot OR before <> row OR after <> row").groupBy("row").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("shared")).hint("merge")

    windows = map_arrow(whole.join(shared, "row"), partial(_emit_windows, body, hot), "w1 long, w2 long, row long, doc long, place long, warm boolean")
    covered = _earlier(windows).hint("merge")
    joined = whole.join(keepers, "row", "left").join(covered, "row", "left").select("row", "doc", *names, "keeper", "covered")
    none = F.lit(None).cast("array<bigint>")
    joined = joined.unionByName(held.where(~long_).select(F.lit(0).cast("long").alias("row"), doc, *names, F.lit(True).alias("keeper"), none.alias("covered")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_texts = _cut(body, batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pc.cast(pa.array(kept_texts, pa.binary()), pa.string())],
                names=[*names, "n_words", "n_removed", "kept_text"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    out = map_arrow(joined, run, f"{schema}, n_words long, n_removed long, kept_text string")
    return unseal(out, docs.columns, **{c: F.col(c) for c in ("n_words", "n_removed", "kept_text")})


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and how many go, with the digest of what is kept."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL = {
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        g AS (SELECT doc_id, word, i, CASE WHEN i <= n - 49 THEN array_to_string(ws[i:i + 49], ' ') END AS gram FROM p),
        f AS (SELECT gram, min(doc_id) AS first FROM g WHERE gram IS NOT NULL GROUP BY gram),
        c AS (SELECT g.doc_id, g.word, g.i, max(CASE WHEN f.first < g.doc_id THEN g.i END) OVER (PARTITION BY g.doc_id ORDER BY g.i ROWS UNBOUNDED PRECEDING) AS cover
              FROM g LEFT JOIN f ON g.gram = f.gram),
        r AS (SELECT doc_id, count(*) FILTER (WHERE cover >= i - 49) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE cover IS NULL OR cover < i - 49) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(r.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id
    """
}
