"""Streaming: windows with a watermark, and steps that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _counted(timed: DataFrame, window) -> DataFrame:
    out = timed.groupBy(window.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per event type and window (tumbling, or sliding); works on a stream (with a watermark) and on a table."""
    return _counted(_timed(events, late), F.window("ts", length, slide) if slide else F.window("ts", length)).drop("end")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same by session: events of a type with no longer gap between them."""
    return _counted(_timed(events, late), F.session_window("ts", gap))


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the parquet files that come into a folder, some a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def caught_up(stream: DataFrame, out: str, state: str) -> None:
    """Append all that is there now to a parquet folder and stop. The state folder remembers what was taken in: run again
    after more files, a crash or a restart, and each window is written once."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
