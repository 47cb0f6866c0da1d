"""Scoring as a stream of files: the checkpoint holds what is done, so that a run resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_stream(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1):
    """Read new parquet files (so many a batch), score and append them; ends when all there are have been read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(source)
    query = score(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def update_in_batches(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """The same, each batch in a folder of its number: a batch done twice replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by event time, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
