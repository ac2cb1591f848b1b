"""Append-only run logs as a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_log(spark: SparkSession, root: str, out: str, checkpoint: str, schema: str | StructType, pattern: str = "*.jsonl"):
    """Appends the new records of run logs under ``root`` to a Parquet table, each once, and returns when all there are
    have been taken; called again, it takes what has come since. A line that cannot be read is left out."""
    source = spark.readStream.schema(schema).options(recursiveFileLookup="true", pathGlobFilter=pattern, mode="DROPMALFORMED").json(root)
    writer = source.withColumn("file", F.col("_metadata.file_path")).writeStream.format("parquet").outputMode("append")
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query
