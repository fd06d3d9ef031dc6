"""Uploads as a stream: repeated content within a watermark goes, the rest is merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "company_slug string, doc_id string, sha256 string, uploaded_at timestamp"


def new_uploads(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Documents (JSON lines below ``folder``) whose content a company hasn't sent within ``delay``."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    rows = rows.withColumn("company_slug", F.lower(F.trim("company_slug")))
    return rows.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["company_slug", "sha256"])


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process what is there now, once; a restart goes on from ``checkpoint``."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
