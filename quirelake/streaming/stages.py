"""Stage files as streams: records that arrive late or twice, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Stage files (JSON lines) of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay: the state of older keys is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; all that is there when it starts is read, then it ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
