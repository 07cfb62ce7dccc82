"""Hourly counts and first observations over an event stream, with late rows up to a bound.

An extension: what the batch operators give over a closed window, these give while it runs. State is
bounded by the watermark; the sink gets finished hours once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New Parquet files in a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly_counts(events: DataFrame, moment: str, kind: str, late: str = "2 hours") -> DataFrame:
    """hour, kind, n. Rows later than ``late`` behind the newest don't count."""
    timed = events.withColumn("at_", F.col(moment).cast("timestamp")).withWatermark("at_", late)
    return timed.groupBy(F.window("at_", "1 hour").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def first_observations(events: DataFrame, moment: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key's first row within the watermark; what comes again is dropped."""
    timed = events.withColumn("at_", F.col(moment).cast("timestamp")).withWatermark("at_", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("at_")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run until the source is used up, writing Parquet; a rerun goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
