"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed-language text.

A word is scored for each learned language by log P(word | language): its count in the sample, smoothed with the
probability of its letters under a trigram model, so unseen words are scored too. Only languages that use the word's
script are candidates. Viterbi over a text's words with a penalty for each switch gives spans of one language; the
text's language is that of most words.

The model is fitted on a bounded sample of labelled documents, ``SAMPLE_DOCS`` in all, shared evenly by the languages and chosen by hash; the
bound is a parameter, so what the driver holds and sends out is bounded. All words of the sample and all languages are
learned. Everything else is a map over whole texts, with no shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import map_arrow, seal, table, unseal

SAMPLE_BYTES, LONGEST = 64 << 20, 1 << 20  # bytes of their texts, in expectation, and of the longest of them
SAMPLE_DOCS = 4000  # labelled documents that the model is fitted on, in expectation: as many of each language, ``LEAST_DOCS`` at least
LEAST_DOCS = 20
PRIOR = 2.0  # weight of the letter model, in words
CLIP = 6.0  # a word speaks for one language against another by this many nats at most
SWITCH = 12.0  # cost of a change of language, in nats
SCRIPT_SHARE = 0.01  # a language uses a script that this share of its words is in
KNOWN_SCRIPT = 0.5  # share of a text's words that must be in a script some language uses
ODD, ODD_FEW = 1.0, 4.0  # a text of n words is foreign if spelt worse than usual by ODD + ODD_FEW / sqrt(n) deviations of a word
LEAST_DEVIATION = 0.3  # of a language's words, in nats a letter: some learned languages are spelt more evenly than any real one
ODDEST = 4.0  # deviations that one word counts for at most, so that a key or a number in a short text does not outweigh the rest
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20  # words whose scores a task keeps, and the bytes that these take at most
UNKNOWN = "und"

#: First code points of letter ranges and the scripts they begin (Unicode blocks, in order).
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3130, "hangul"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
]
STARTS, NAMES = [a for a, _ in SCRIPT_RANGES], [b for _, b in SCRIPT_RANGES]
LETTERS = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    """The script of a word's first letter."""
    return NAMES[bisect_right(STARTS, ord(word[0])) - 1]


@dataclass
class Model:
    """Scores of words; ``langs`` in code-point order. A copy in a task also caches the words it has met."""

    langs: list[str]
    words: dict[str, int]
    table: np.ndarray  # a row for each known word: scores of the languages
    trigrams: dict[str, list[float]]
    unseen: list[float]
    scripts: dict[str, list[bool]]
    prior: list[float]
    usual: list[tuple[float, float]] = field(default_factory=list)  # median and deviation of the spelling of a language's words
    known: int = field(init=False, default=-1)  # words learned; the rest of ``words`` is cache
    spelt: np.ndarray | None = field(init=False, default=None)

    def make_room(self) -> None:
        """Room for cached words; made where words are scored, so that the driver neither holds nor sends it."""
        if self.known < 0:
            self.known = len(self.words)
            width = max(1, len(self.langs))
            self.table = np.concatenate([self.table, np.zeros((min(CACHE_WORDS, CACHE_BYTES // (4 * width)), width), np.float32)])

    def score(self, word: str) -> np.ndarray:
        """Scores of a word outside the vocabulary, by its letters and its script."""
        total = np.array(self.unseen) * 0
        padded = f"^{word}$"
        for i in range(len(padded) - 2):
            total += self.trigrams.get(padded[i : i + 3], self.unseen)
        return narrowed(total, self.scripts.get(script(word)))

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' scores, one row each."""
        self.make_room()
        if len(self.words) - self.known > (len(self.table) - self.known) // 2:
            for w in list(self.words)[self.known :]:
                del self.words[w]
            if self.spelt is not None:
                self.spelt[self.known :] = np.nan
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = self.table[ids]
        for i in np.flatnonzero(ids < 0):
            w = words[i]
            k = get(w, -1)
            if k < 0:
                s = self.score(w)
                if len(self.words) < len(self.table):
                    k = self.words[w] = len(self.words)
                    self.table[k] = s
                out[i] = s
            else:
                out[i] = self.table[k]
        return out


    def oddity(self, word: str, i: int) -> float:
        """Log-likelihood of a letter of the word, in deviations from what is usual in language ``i``; infinite in a script that none uses."""
        if not any(self.scripts.get(script(word), ())):
            return -math.inf
        padded = f"^{word}$"
        middle, deviation = self.usual[i]
        spelt = sum(self.trigrams.get(padded[k : k + 3], self.unseen)[i] for k in range(len(word)))
        return max((spelt / len(word) - middle) / deviation, -ODDEST)

    def fits(self, words: list[str], path: np.ndarray) -> bool:
        """Whether words read as languages ``path`` look like words of these, by script and spelling. Repeated words count once."""
        if self.spelt is None:
            self.spelt = np.full(self.table.shape, np.nan, np.float32)
        read = dict(zip(words, path.tolist()))
        langs = np.fromiter(read.values(), np.int64, len(read))
        ids = np.fromiter((self.words.get(w, -1) for w in read), np.int64, len(read))
        odd = np.where(ids < 0, np.nan, self.spelt[ids, langs])
        new = np.flatnonzero(np.isnan(odd))
        if len(new):
            names = list(read)
            for j in new.tolist():
                odd[j] = self.oddity(names[j], langs[j])
                if ids[j] >= 0:
                    self.spelt[ids[j], langs[j]] = odd[j]
        letters = np.fromiter(map(len, read), np.float64, len(read))
        known = odd > -np.inf
        if known.mean() < KNOWN_SCRIPT:
            return False
        return float(np.average(odd[known], weights=letters[known])) >= -ODD - ODD_FEW / math.sqrt(known.sum())


def narrowed(scores: np.ndarray, candidates: list[bool] | None) -> np.ndarray:
    """Scores relative to the best, clipped; languages that do not use the script get the least. No candidate: all alike."""
    if candidates is None or not any(candidates):
        return np.zeros(len(scores), np.float32)
    mask = np.array(candidates)
    return np.where(mask, np.maximum(scores - scores[mask].max(), -CLIP), -CLIP).astype(np.float32)


def usual_spelling(i: int, words: dict[str, list[int]], grams: dict[str, list[float]], starts: dict[str, list[float]]) -> tuple[float, float]:
    """Median and deviation (by the median, so that labelled junk hardly counts) of words' log-likelihood of a letter in language ``i``, each word
    judged by the others.
    """
    values = []
    for word, row in words.items():
        if row[i]:
            padded, own = f"^{word}$", 1 + math.log(row[i])
            left = [(max(0.0, grams[padded[k : k + 3]][i] - own), max(0.0, starts[padded[k : k + 2]][i] - own)) for k in range(len(word))]
            values.append(sum(math.log((c + 0.05) / (b + 0.05 * 60)) for c, b in left) / len(word))
    if len(values) < 2:
        return 0.0, math.inf  # nothing to tell by
    middle = float(np.median(values))
    return middle, max(1.4826 * float(np.median(np.abs(np.array(values) - middle))), LEAST_DEVIATION)


def fit_model(counts: Iterable[tuple[str, str, int]], docs: dict[str, int]) -> Model:
    """The model from (word, language, count) and the number of documents of each language."""
    langs = sorted(docs)
    at = {x: i for i, x in enumerate(langs)}
    n = len(langs)
    words: dict[str, list[int]] = defaultdict(lambda: [0] * n)
    grams: dict[str, list[float]] = defaultdict(lambda: [0.0] * n)
    starts: dict[str, list[float]] = defaultdict(lambda: [0.0] * n)
    total, used = [0] * n, [Counter() for _ in langs]
    for word, lang, count in counts:
        i = at[lang]
        words[word][i] += count
        total[i] += count
        used[i][script(word)] += count
        padded = f"^{word}$"
        weight = 1 + math.log(count)  # words count by type, so that common words do not drown the spelling of others
        for k in range(len(padded) - 2):
            grams[padded[k : k + 3]][i] += weight
            starts[padded[k : k + 2]][i] += weight
    trigrams = {g: [math.log((c + 0.05) / (b + 0.05 * 60)) for c, b in zip(row, starts[g[:2]], strict=True)] for g, row in grams.items()}
    unseen = [math.log(1 / 200)] * n
    scripts = {s: [used[i][s] >= SCRIPT_SHARE * max(1, total[i]) for i in range(n)] for s in sorted(set().union(*used))} if n else {}
    everything = max(1, sum(docs.values()))
    usual = [usual_spelling(i, words, grams, starts) for i in range(n)]
    model = Model(langs, {}, np.zeros((len(words), max(1, n)), np.float32), trigrams, unseen, scripts, [docs[x] / everything for x in langs], usual)
    for k, (word, row) in enumerate(words.items()):
        padded = f"^{word}$"
        spelt = np.sum([trigrams[padded[j : j + 3]] for j in range(len(padded) - 2)], axis=0)
        scores = np.log(np.array(row) + PRIOR * np.exp(spelt) + 1e-12) - np.log(np.array(total) + PRIOR)
        model.words[word] = k
        model.table[k] = narrowed(scores, scripts.get(script(word)))
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows: of each language, documents whose hash of key and text falls under its share of ``sample_docs`` and of ``SAMPLE_BYTES``.

    Every language that labels a row with letters is learned, from ``LEAST_DOCS`` documents at least (all it has, if fewer). Null texts and labels teach
    nothing, null and repeated keys are drawn as others are, since their texts differ; texts over ``LONGEST`` bytes are not
    learned from; rows that repeat count each; no labelled rows give a model without languages.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.withColumn("bytes", F.octet_length("t"))
    held = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("bytes", F.lit(LONGEST))).alias("bytes")).collect()  # a row for each language that is learned
    sizes = {r["l"]: r["n"] for r in held}
    if not sizes:
        return fit_model([], {})
    docs_each, bytes_each = max(LEAST_DOCS, sample_docs // len(sizes)), SAMPLE_BYTES // len(sizes)
    parts = {r["l"]: min(1.0, docs_each / r["n"], bytes_each / max(1, r["bytes"])) for r in held}
    share = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair])
    draw = F.pmod(F.xxhash64(F.lit(7), "k", "t"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = rows.where(F.col("bytes") <= LONGEST).where(draw < F.element_at(share, F.col("l")))
    word = F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")
    counts = some.select("l", word).where("w <> ''").groupBy("w", "l").agg(F.count(F.lit(1)).alias("n"))
    found = counts.toArrow().sort_by([("w", "ascending"), ("l", "ascending")])
    return fit_model(zip(*(found[c].to_pylist() for c in ("w", "l", "n"))), sizes)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each row of scores, where every change costs ``penalty``.

    One language is best throughout if no stretch speaks for another by more than half the penalty; only other
    texts go through the full recursion.
    """
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(len(scores), best)
    n = scores.shape[1]
    value = scores[0].tolist()
    back = np.empty((len(scores), n), np.int16)
    stay = list(range(n))
    for t, row in enumerate(scores.tolist()):
        if t:
            top = max(value)
            k, floor = value.index(top), top - penalty
            came = stay
            if min(value) < floor:
                came = [i if value[i] >= floor else k for i in stay]
            back[t] = came
            value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    path = np.empty(len(scores), np.int64)
    at = value.index(max(value))
    for t in range(len(scores) - 1, -1, -1):
        path[t] = at
        if t:
            at = back[t, at]
    return path


def label(text: str | None, model: Model) -> tuple[str, float, list[dict]]:
    """(language, score, spans) of a text; spans are character ranges of one language each."""
    return judge(text, model, False)[:3]


def judge(text: str | None, model: Model, fits: bool = True) -> tuple[str, float, list[dict], bool]:
    """``label`` and, if asked for, whether the text looks like its languages; any text with letters does if none was learned."""
    found = [m.span() for m in LETTERS.finditer(text)] if text else []
    if not found or not model.langs or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0, [], bool(found) and not model.langs and any(c.isalpha() for c in text)
    words = [text[a:b].lower() for a, b in found]
    scores = model.rows(words)
    path = viterbi(scores, SWITCH)
    held = np.bincount(path, minlength=len(model.langs))
    best = int(held.argmax())
    own = scores[path == best].sum(axis=0, dtype=np.float64) + np.log(np.array(model.prior) + 1e-9)
    sure = 1 / np.exp(np.maximum(own - own[best], -50)).sum()
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    spans = [{"lang": model.langs[path[a]], "start": found[a][0], "end": found[b - 1][1]} for a, b in zip(cuts, cuts[1:])]
    return model.langs[best], float(min(1.0, sure * held[best] / len(path))), spans, fits and model.fits(words, path)


NEW = ("lang_pred", "lang_score", "lang_spans", "lang_fits")
SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def identify(docs: DataFrame, model: Model, text: str = "text", fits: bool = False) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_spans (characters from start to end, exclusive).

    lang_pred is ``und`` with score 0 for null texts, texts without letters and a model without languages. Letters
    of a script that no language uses speak for none, so such a text gets the first language, at its share of the labelled rows.
    With ``fits`` comes lang_fits: whether script and spelling are those of a learned language, whatever the score.
    All columns and rows pass through, repeated ones too; a new name that is taken gets an underscore; an empty
    table gives none.
    """
    held, at = seal(docs)
    names = held.columns
    sent = held.sparkSession.sparkContext.broadcast(model)  # the words of a bounded sample and their trigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            got = [judge(x.as_py(), own, fits) for x in batch.column(at[text])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], SPANS), pa.array([g[3] for g in got], pa.bool_())],
                names=[*names, *NEW],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    out = map_arrow(held, run, f"{schema}, lang_pred string, lang_score double, lang_spans array<struct<lang:string,start:long,end:long>>, lang_fits boolean")
    return unseal(out, docs.columns, **{c: F.col(c) for c in (NEW if fits else NEW[:3])})


def held_out(key: str, modulus: int, remainder: int) -> F.Column:
    """Whether the crc32 of a key as text leaves ``remainder``; false for null keys."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    out = identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("spans"))


QUERIES = {"op4_language_id": op4_language_id}
