"""Writers: run logs that only grow, manifests whose order counts, and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def write_manifest(rows: DataFrame, path: str, order: list[str]) -> None:
    """Keep rows with their place, ``ord``, in the given order. A manifest is a drawn sample, so one task numbers it."""
    rows.withColumn("ord", F.row_number().over(Window.orderBy(*order))).write.mode("errorifexists").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("ord")


def schema_json(rows: DataFrame) -> str:
    return rows.schema.json()
