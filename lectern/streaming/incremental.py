"""Incremental runs: what a folder gained since the last one, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, glob: str, schema: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Run ``step`` over the files not seen before and append to ``out``. How many rows that were is in ``out``'s own log."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    query = step(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type, late rows admitted for ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
