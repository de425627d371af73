"""Windows over event streams: the same functions on a batch or a stream, with watermarks where a stream is late.

Defined results: events without a time are left out; events later than the watermark are dropped by a stream and counted
by a batch; a session ends after its gap; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).filter("at IS NOT NULL")
    return e.withWatermark("at", late) if late else e


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(event_type, begin, n, total) of each window."""
    g = _timed(events, late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("begin"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, begin, end, n): runs of a user's events with no pause of gap or more."""
    g = _timed(events, late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return g.select("user_id", F.col("w.start").alias("begin"), F.col("last").alias("end"), "n")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream to Parquet with its checkpoint in a shared folder; it stops when all that is there has been read."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
