"""Streaming variants: bucket counts, visit clusters and an exactly-once file sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dayloom.operators.visits import GAP_SECONDS, pick_title, pick_transition
from dayloom.sources import files


def file_stream(spark: SparkSession, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:  # noqa: ANN001
    """New Parquet files of a folder or pattern, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def bucket_counts(rows: DataFrame, time: str, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Rows in each tumbling window; a window is final once the watermark has passed it."""
    timed = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("bucket"), "n")


def sessions(rows: DataFrame, keys: list[str], time: str, gap: str, aggregates: list[Column], lateness: str = "10 minutes") -> DataFrame:
    """Clusters of rows that follow one another within the gap, whatever batches they come in."""
    timed = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    found = timed.groupBy(*keys, F.session_window("_at", gap)).agg(F.min("_at").alias("started_at"), F.max("_at").alias("ended_at"), *aggregates)
    return found.drop("session_window")


def page_view_sessions(visits: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Page views of a stream of visits; unlike per-payload clustering a payload's end does not cut them."""
    picks = [pick_title(F.col("title"), F.col("_at")).alias("title"), pick_transition(F.col("transition")).alias("transition"), F.count(F.lit(1)).alias("visit_span_count")]
    return sessions(visits, ["source_device", "browser", "profile", "url"], "visit_time", f"{GAP_SECONDS} seconds", picks, lateness)


def once_per_batch(work: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that skips batches it has finished before: each leaves a marker in the ledger folder."""

    def run(batch: DataFrame, number: int) -> None:
        marker = f"{ledger.rstrip('/')}/{number:012d}"
        if files.exists(batch.sparkSession, marker):
            return
        work(batch, number)
        batch.sparkSession.createDataFrame([(number,)], "batch bigint").coalesce(1).write.mode("overwrite").json(marker)

    return run


def run_available(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Work off all that is there, then stop; the checkpoint is the cursor and moves after the work of a batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()
    query.awaitTermination()
    return query
