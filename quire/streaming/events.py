"""Event streams: watermarked windows, sessions and duplicates, for readStream or batch alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of event files; the schema is read from those that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def counts_by_window(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events by window and type; events later than the watermark are dropped."""
    w = F.window("ts", width)
    return (
        events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user that end after a gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Events without repetitions inside of the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
