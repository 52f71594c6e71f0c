"""Feedback and concepts as streams: files that arrive, counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream of the files in a folder, or of one file by its name in its folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.format(kind).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        return reader.option("pathGlobFilter", at.getName()).load(at.getParent().toString())
    return reader.load(path)


def once_by_id(stream: DataFrame, key: str = "feedback_id", time: str = "received_at", late: str = "30 days") -> DataFrame:
    """Each key once while its first arrival is within `late` of the newest row; state older than that is dropped."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per window and key; a window is given out once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("from"), F.col("window.end").alias("until"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("from"), F.col("session_window.end").alias("until"), key, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes in all that is there and ends; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_each_batch(stream: DataFrame, work, checkpoint: str, mode: str = "update") -> None:
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
