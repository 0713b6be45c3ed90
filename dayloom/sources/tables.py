"""Opening the tables of one input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` as a DataFrame; the folder may be on any Hadoop file system."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
