"""Structured Streaming twins: the same operators over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream (files of its schema)."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else sf_dir + "/events*.parquet")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result table."""
    name = "t" + uuid.uuid4().hex[:12]
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_counts(stream: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events by type in sliding windows, under a watermark."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


def state_counts(stream: DataFrame) -> DataFrame:
    """Mutations per document: the streaming side of the registry's log."""
    return stream.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("creates"), F.count_if(F.col("event_type") == "error").alias("tombstones"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
