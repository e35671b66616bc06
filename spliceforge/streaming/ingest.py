"""Incremental ingest: transcripts arrive in files, and the stored isoform counts follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.operators.current import current_rows


def transcript_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, store: str, checkpoint: str):
    """Appends each batch under its own number, so that a batch that is run again replaces itself; returns the started query."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sample_counts(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Distinct transcript versions by sample and week of arrival; rows later than ``delay`` behind the newest are left out."""
    once = stream.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["transcript_id", "loaded_at"])
    return once.groupBy(F.window("loaded_at", "7 days").alias("week"), "sample_name").agg(F.count(F.lit(1)).alias("n"), F.sum("coverage").alias("reads"))


def stored_current(spark: SparkSession, store: str, *columns: str) -> DataFrame:
    """The current rows over all batches so far."""
    return current_rows(spark.read.parquet(store), *columns)
