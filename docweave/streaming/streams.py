"""The incremental parts as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder as they arrive: path, text."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def chunk_stream(docs: DataFrame) -> DataFrame:
    """path, chunk_index and chunk of streamed documents; no state is kept."""
    return docs.select("path", F.posexplode(T.chunks(T.sentences(F.col("text")))).alias("i", "chunk")).select("path", (F.col("i") + 1).alias("chunk_index"), "chunk")


def latest_status(events: DataFrame, keys: list[str], status: str = "status", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """The newest status of each key, updated as events arrive; events later than the watermark are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(*keys).agg(F.max_by(status, ts).alias(status), F.max(ts).alias("updated_at"))


def windowed_counts(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works through what is there, then stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
