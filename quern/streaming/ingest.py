"""Incremental ingestion of documents; beyond what the batch operators need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_arrivals(stream: DataFrame, key: str, time: str, lateness: str = "7 days") -> DataFrame:
    """Each key once; state older than the lateness is dropped, so late repeats beyond it are not recognised."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def arrivals_by_window(stream: DataFrame, time: str, group: str, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(window_start, group, documents): tumbling counts, final once the watermark has passed a window."""
    g = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), F.col(group))
    return g.agg(F.count("*").alias("documents")).select(F.col("w.start").alias("window_start"), group, "documents")


def write_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda b: b):
    """Applies a batch operator to every micro-batch and appends what it gives; a batch written before a failure is written again under the same number."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
