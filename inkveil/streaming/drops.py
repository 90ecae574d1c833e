"""Redaction of files as they are dropped into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkveil.plans.redaction import redact_identifiers


def redact_drops(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Read Parquet files of documents as a stream, redact identifiers, and append Parquet files to ``target``.

    Every document is redacted on its own, so the stream keeps no state, and the file sink's log and the checkpoint give
    each document exactly once. The checkpoint must be on shared storage.
    """
    documents: DataFrame = spark.readStream.schema(schema).parquet(source)
    writer = redact_identifiers(documents).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
