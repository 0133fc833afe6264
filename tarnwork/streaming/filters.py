"""The text filters on streams of payloads. They keep no state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tarnwork.plans import pipeline

PAYLOAD = "name string, body string"


def read_payloads(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Payload files (Parquet: name, body) as they arrive in a folder."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", per_trigger).parquet(path)


def clean_stream(payloads: DataFrame, chain: pipeline.Pipeline | None = None) -> DataFrame:
    """Payloads through the filter for their kind, or through a chain."""
    return chain.execute_traced(payloads) if chain is not None else pipeline.routed(payloads)


def start(cleaned: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes cleaned payloads as Parquet, each once."""
    writer = cleaned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
