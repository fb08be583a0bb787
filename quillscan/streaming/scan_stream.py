"""Structured Streaming: the detectors over arriving files, with counts by type in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.data_rights import has_email, has_ipv4


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, arrived timestamp", files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Personal-data findings per window; state older than the watermark is dropped."""
    kinds = F.array_compact(F.array(F.when(has_email(F.col("text")), F.lit("email")), F.when(has_ipv4(F.col("text")), F.lit("ip"))))
    found = stream.withWatermark("arrived", late).select("arrived", F.explode(kinds).alias("kind"))
    return found.groupBy(F.window("arrived", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
