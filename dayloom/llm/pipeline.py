"""The corpus pipeline as a query."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
