"""Incremental task status: a stream of events kept as the latest row of each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tasks


def events(spark: SparkSession, folder: str, schema, *, files_per_batch: int = 10) -> DataFrame:
    """A stream of event rows from Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def mirror(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], at: str) -> StreamingQuery:
    """Write each batch's latest rows per key; ``state`` reads the table back.

    A batch writes to its own folder by number, so a batch that is run again after a failure
    replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        tasks.latest(batch, keys, at).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, folder: str, keys: list[str], at: str) -> DataFrame:
    return tasks.latest(spark.read.parquet(folder), keys, at).drop("batch")


def windowed_counts(stream: DataFrame, at: str = "ts", *by: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts by time window and columns; rows later than ``lateness`` are dropped with their state.

    Times without a zone count as those of the session's.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
