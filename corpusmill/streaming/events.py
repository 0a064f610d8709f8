"""Structured Streaming over the events table: admission once, windows, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.io import shared_folder, table


def stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; event times without a zone are read as UTC."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives the rows of its sink, a table in the shared folder."""
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    job = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


def admitted(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once; repetitions that come within ``late`` of the newest event are dropped, state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def per_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total over tumbling windows; windows come out once the watermark has passed them."""
    counted = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    )
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")
