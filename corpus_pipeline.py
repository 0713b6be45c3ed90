"""The corpus pipeline: five stages from documents to packed sequences, each an operator of ``dayloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back as the next stage's documents, so a lost executor never costs an earlier stage; the folder of a stage is deleted once the next is written. All stages but the
last return the columns of ``documents``; other columns of the input, whatever their names, are left out, since that is what a stage promises.

Every stage takes nulls in any column, empty and very long texts, rows that repeat and empty tables; what it does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import near_copies, op3_packing, op4_language, op5_simhash, op6_mixing, op10_substrings
from dayloom.llm.common import shared_dir, table
from dayloom.sources import files
from dayloom.sources.scratch import cleared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without letters, or in a script or spelling of no learned language, go. Missing languages
    are filled in. Where none could be learned all that have letters stay, as they are.

    Null and empty texts have no letters and go. Null keys and sources pass. Rows that repeat are judged alike, a tie of languages goes to the first
    by code point, whole texts are read however long, and an empty table gives none.
    """
    known = op4_language.identify(docs.select(*COLUMNS), op4_language.train(docs), fits=True).where("lang_fits")
    return known.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(op4_language.UNKNOWN)))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of 5-word similarity 0.8 and over to an earlier one that stays.

    Rows are compared within op 5's components of SimHash fingerprints and, since those part most rows as like as that, within MinHash bands.
    Earlier means a smaller key, null keys last, ties by a hash of the text; of rows equal in both one stays. Null and empty texts are copies of
    one another, so one stays. Texts under 5 words are compared as a whole, long ones by all their shingles. An empty table gives none.
    """
    return op5_simhash.dedup(docs.select(*COLUMNS), shingle=near_copies.SHINGLE, similarity=near_copies.SIMILARITY, bands=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words that an earlier one has; those left without words go, untouched texts stay as they are.

    Null keys are later than any other, and rows of one key never take from each other; so rows that repeat stay together or go together. Null and
    empty texts have nothing to take and stay. Whole texts are read however long; n_chars follows the text. An empty table gives none.
    """
    cut = op10_substrings.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": length}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus at its target weights: a document as often as the mix takes it.

    A null source is a source of its own, the last. Null and empty texts have size 0 and are taken at their source's rate like others. Null keys and rows that repeat
    count each; ties are told apart by hashes, so reruns agree. An empty table gives none.
    """
    return op6_mixing.emit(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of the mixed corpus in training sequences.

    Null and empty texts take a piece of no words, long texts several of a sequence's length. A null source is one of its own; rows that repeat
    (as the mix makes them) and null keys are packed each, repeats never in one sequence. An empty table gives none.
    """
    return op3_packing.pack(docs.select(*COLUMNS)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the language model, XXH64 fingerprints, hashed sampling nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of ``sf_dir``."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    paths = []
    for i, (name, stage) in enumerate(STAGES):
        paths.append(f"{folder}/{i}-{name}")
        with cleared(spark):  # of the stage's own intermediate tables
            stage(spark, docs, sf_dir).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
        if i:
            files.delete(spark, paths[i - 1])  # this stage is whole, so nothing reads its input again
    return docs
