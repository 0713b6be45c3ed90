"""Toxicity by compression distance, with separate zstandard dictionaries for toxic and ordinary text.

Two dictionaries are trained by zstandard, one on whole texts labelled toxic and one on whole texts labelled ordinary. A text is cut into
windows of ``WINDOW`` words; each is compressed with either dictionary, and the difference of the two lengths tells which kind of text explains the
window better. A document's differences (their largest, mean and sum, and how many reach each of some thresholds) become a probability by
logistic weights, fitted on labelled documents whose differences were measured by dictionaries that had not seen them.

Words are joined by ``GAP`` spaces, which makes a whole known word stand out from a chance match of some letters.
Documents are read once more and scored where they lie, the windows of ``TOGETHER`` bytes of texts at a time. The labelled sample is bounded by ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` rows and ``SAMPLE_BYTES``
bytes of text; dictionaries are trained from it on the driver, while its windows are measured by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import byte_slices, map_arrow, materialize, seal, table, unseal

SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 1500, 8000, 24 << 20  # labelled rows, and bytes of their texts, that the dictionaries are trained on
CALIBRATION = 4500  # of these rows, about, that the weights are fitted on
TOXIC_BYTES, ORDINARY_BYTES = 64_000, 1_000_000  # of the dictionaries, at most
PIECE = 4096  # bytes of a training sample
WINDOW = 5  # words
REMEMBERED = 100_000  # windows whose difference a task keeps, about 20 MB
TOGETHER = 4 << 20  # bytes of texts whose windows are compressed in one call
GAP = b"   "
REACHED = range(-2, 11)  # bytes of difference whose windows are counted
FEATURES = 12 + len(REACHED)
KEPT = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256)).lower()  # of lower-cased UTF-8; what is no letter is a space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(KEPT).split()


def spaced(words: list[bytes]) -> bytes:
    return GAP + GAP.join(words) + GAP


def windows_of(words: list[bytes]) -> list[bytes]:
    """The windows of a text, each ``spaced``."""
    each = iter(words)
    whole = list(map(GAP.join, zip(repeat(b""), *[each] * WINDOW, repeat(b"")))) if len(words) >= WINDOW else []
    rest = words[len(whole) * WINDOW :]
    return [*whole, spaced(rest)] if rest else whole


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float] = field(default_factory=list)  # of ``features``


def train_dictionary(size: int, texts: list[bytes]) -> bytes:
    """A dictionary trained on texts (``spaced``); with too few of them, the texts' own end."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE) if len(t) - i >= 8]
    try:
        return zstandard.train_dictionary(size, pieces, k=40, d=8, f=22, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def dictionaries(rows: list[tuple[bytes, int]]) -> Model:
    """Both dictionaries from labelled texts (``spaced``), without weights yet."""
    return Model(train_dictionary(TOXIC_BYTES, [t for t, y in rows if y == 1]), train_dictionary(ORDINARY_BYTES, [t for t, y in rows if y == 0]))


class Compressors:
    """The two compressors of a model; built where they are used, since they cannot be sent."""

    def __init__(self, model: Model) -> None:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            19, strategy=zstandard.STRATEGY_BTOPT, search_log=4, target_length=16, min_match=5,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=parameters)
            known = zstandard.ZstdCompressionDict(content)  # a trained one with its tables; other bytes count as content
            known.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)

        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)
        # lines repeat within and across documents, and a window's lengths depend on it alone
        self.difference = lru_cache(REMEMBERED)(lambda w: int(self.lengths(self.ordinary, [w])[0] - self.lengths(self.toxic, [w])[0]))
        self.known: dict[bytes, int] = {}

    @staticmethod
    def lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
        """Compressed lengths, each window on its own, in one call of the library."""
        sizes = np.fromiter(map(len, windows), np.uint64, len(windows))
        places = np.column_stack([np.cumsum(sizes) - sizes, sizes])
        found = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(windows), places.tobytes()))
        return np.fromiter(map(len, map(found.__getitem__, range(len(windows)))), np.int64, len(windows))

    def differences(self, words: list[bytes]) -> list[int]:
        """For each window of a text, the bytes by which it is shorter with the toxic dictionary than with the ordinary one."""
        return list(map(self.difference, windows_of(words)))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """``features`` of many texts. Their windows, each once, are compressed with one dictionary and then with the other, so that a dictionary's tables stay at hand."""
        each = [windows_of(words_of(t)) for t in texts]
        new = sorted({w for w in chain.from_iterable(each) if w not in self.known})
        if new:
            self.known.update(zip(new, (self.lengths(self.ordinary, new) - self.lengths(self.toxic, new)).tolist()))
        counts = np.fromiter(map(len, each), np.int64, len(each))
        found = features(np.fromiter(map(self.known.__getitem__, chain.from_iterable(each)), np.int64, int(counts.sum())), counts)
        if len(self.known) > REMEMBERED:  # those known longest go
            self.known = dict(islice(self.known.items(), len(self.known) - REMEMBERED, None))
        return found


def features(differences: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row for each text, of which ``counts`` says how many of the differences it has: 1, the largest difference, the mean of the three largest and of all,
    logarithms (of the sum of gains, of windows that gain 1 to 6 bytes, of all windows), and the numbers of windows that reach each of ``REACHED``, in tens."""
    n = np.maximum(counts, 1)  # no window counts as one of no difference
    ends = np.cumsum(n)
    starts = ends - n
    d = np.zeros(int(n.sum()), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    d[np.repeat(counts > 0, n)] = differences
    d = d[np.lexsort((d, text))]
    if not len(n):
        return np.empty((0, FEATURES))
    total = lambda x: np.add.reduceat(x, starts)
    top = total(np.where(np.arange(len(d)) >= np.repeat(ends - 3, n), d, 0)) / np.minimum(n, 3)
    reach = {k: total((d >= k).astype(np.int64)) for k in REACHED}
    logs = np.log1p([total(np.maximum(d, 0)), *(reach[k] for k in range(1, 7)), counts])
    return np.column_stack([np.ones(len(n)), d[ends - 1], top, total(d) / n, *logs, *(x / 10 for x in reach.values())])


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit_threshold(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method with a small penalty."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    for _ in range(steps):
        p = probability(x, w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(k, y, half, h, t): the labelled rows that a model is fitted on, those with the least hashes of their keys.

    A key that is labelled both ways teaches nothing; one that repeats in ``docs`` gives its shortest text (of several, that of the least MD5). Each
    label has half of ``SAMPLE_BYTES``, and what the other leaves; texts that do not fit are passed over. Null keys and labels other than 0 and 1 do not count.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(9), "k")
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    marks = marks.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y", order.alias("h"))
    chosen = marks.where("y = 1").orderBy("h", "k").limit(SAMPLE_TOXIC).unionByName(marks.where("y = 0").orderBy("h", "k").limit(SAMPLE_ORDINARY))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = F.struct(F.octet_length("t").alias("n"), F.md5("t").alias("digest"))
    sizes = texts.join(F.broadcast(chosen), "k").groupBy("k", "y", "h").agg(F.min(size).alias("s")).select("k", "y", "h", "s.n", "s.digest")
    # a row of the bounded sample each, without its text
    waiting = sorted(sizes.collect(), key=lambda r: (-r["y"], r["h"], r["k"]))
    taken, spent = [], {0: 0, 1: 0}
    for most in (SAMPLE_BYTES // 2, SAMPLE_BYTES):  # half the bytes are for each label; what one leaves the other may take
        passed = []
        for r in waiting:
            if spent[r["y"]] + r["n"] <= most and sum(spent.values()) + r["n"] <= SAMPLE_BYTES:
                spent[r["y"]] += r["n"]
                taken.append((r["k"], r["y"], r["h"], r["digest"]))
            else:
                passed.append(r)
        waiting = passed
    wanted = spark.createDataFrame(taken, sizes.select("k", "y", "h", "digest").schema)
    found = texts.join(F.broadcast(wanted), "k").where(F.md5("t") == F.col("digest")).dropDuplicates(["k"])
    return materialize(found.select("k", "y", F.pmod(F.xxhash64(F.lit(10), "k"), F.lit(2)).alias("half"), "h", "t"), SAMPLE_TOXIC + SAMPLE_ORDINARY)


def measured(sample: DataFrame, models: list[Model]) -> DataFrame:
    """(y, h, x): the features of sample rows, by the model of the half that they are not in."""
    sent = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Compressors(m) for m in sent.value]
        for batch in batches:
            for part in byte_slices(batch, 3, TOGETHER):
                half = part.column(1).to_numpy(zero_copy_only=False)
                texts = np.array([*part.column(3).to_pylist(), None], object)[:-1]
                x = np.empty((len(texts), FEATURES))
                for h in (0, 1):
                    x[half == h] = own[1 - h].features(texts[half == h].tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "h", "x"])

    return map_arrow(sample.select("y", "half", "h", "t"), run, "y int, h long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model fitted on ``labelled_sample``.

    Dictionaries of either half measure the other half's documents, which sets the weights; those of the
    model are trained on all. Without labelled rows every text gets a score of 0.5.
    """
    sample = labelled_sample(docs, labels, key, text, label)
    texts = sorted((r["h"], r["half"], r["y"], spaced(words_of(r["t"]))) for r in sample.toLocalIterator())  # at most SAMPLE_BYTES of text
    halves = [dictionaries([(t, y) for _, h, y, t in texts if h == half]) for half in (0, 1)]
    share = min(1.0, CALIBRATION / max(1, len(texts)))
    some = sample.where((F.col("y") == 1) | (F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(1000)) < int(1000 * share)))
    found = sorted((r["h"], r["y"], r["x"]) for r in measured(some.repartition(16), halves).collect())  # features of the bounded sample
    weights = fit_threshold(np.array([x for _, _, x in found]).reshape(-1, FEATURES), np.array([y for _, y, _ in found], float))
    if share < 1:  # ordinary rows were thinned for the fit: their true number sets the base rate
        weights[0] += np.log(share)
    model = dictionaries([(t, y) for _, _, y, t in texts])
    model.weights = weights.tolist()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with tox_score (0 to 1) and tox_bytes, the largest difference of a window.

    Null, empty and wordless texts have no windows and get the score of no evidence. Whole texts are scored, window by
    window. All columns and rows pass through, repeated ones too; a new name that is taken gets an underscore; an
    empty table gives none.
    """
    held, at = seal(docs)
    names = held.columns
    sent = held.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = Compressors(sent.value), np.array(sent.value.weights)
        for batch in batches:
            for part in byte_slices(batch, names.index(at[text]), TOGETHER):
                x = own.features(part.column(at[text]).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(probability(x, weights)), pa.array(x[:, 1].astype(np.int64))], names=[*names, "tox_score", "tox_bytes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    out = map_arrow(held, run, f"{schema}, tox_score double, tox_bytes long")
    return unseal(out, docs.columns, tox_score=F.col("tox_score"), tox_bytes=F.col("tox_bytes"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of documents that are not held out."""
    out_of = lambda key: F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~out_of("doc_id"))
    scored = score(docs.withColumn("held_out", out_of("doc_id")), train(docs, labels))
    return scored.select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_bytes").alias("largest_difference"))


QUERIES = {"op2_toxicity": op2_toxicity}
