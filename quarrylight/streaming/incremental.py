"""Incremental indexing: documents that arrive are turned into elements as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.sources.readers import line_elements


def stream_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def index_stream(documents: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends the elements of each document once; the same document within the watermark is dropped, restarts go on
    where they stopped."""
    once = documents.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["doc_name"])
    return line_elements(once).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrivals(documents: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Documents and characters per window of arrival and source."""
    return documents.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
