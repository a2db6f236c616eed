"""Incremental ingest: new files of a folder pass the licence gate once and are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.linking import licence_gate


def papers_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Papers (JSON lines) as they come; a batch reads a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(papers: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what the licence gate lets through to ``table`` and end when all present files are read.

    The file sink and the checkpoint make every file count once, restarts included.
    """
    return licence_gate(papers).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
