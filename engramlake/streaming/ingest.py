"""Streaming ingest: files in, deduplicated memories out, and counters with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """Parquet files as they arrive, a bounded number a batch: the write queue's back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(rows: DataFrame, ts: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state older than ``lateness`` is dropped."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def rates(rows: DataFrame, ts: str, by: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Rows of each window, final once the watermark has passed."""
    counted = rows.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("start"), "n")


def run_once(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that has arrived and stop; the checkpoint resumes where the last run ended."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
