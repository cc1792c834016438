"""Predictions that arrive as files: first answers kept, coverage kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_predictions(spark: SparkSession, path: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """A stream of the first prediction of each sample_id among those at most ``delay`` apart.

    schema must hold sample_id and the timestamp arrived. State is bounded by the watermark.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sample_id"])


def write_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is there and stop; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Per key: expected, present and right so far. Missing answers aren't scored wrong in a snapshot."""
    joined = gold.join(predictions.select("sample_id", "pred"), "sample_id", "left")
    return joined.groupBy(key).agg(F.count("*").alias("expected"), F.count("pred").alias("present"), F.count_if(F.col("gold") == F.col("pred")).alias("correct"))


def unfinished(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Requests without an answer yet: what a resumed run has to do."""
    return requests.join(predictions.select("sample_id").distinct(), "sample_id", "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per window and type, batch or streaming; a Spark extra without a counterpart."""
    stream = events.withWatermark("ts", delay) if events.isStreaming else events
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
