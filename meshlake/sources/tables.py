"""Parquet tables of a folder, read at once or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, time: str) -> DataFrame:
    """The table as a stream, with ``time`` as a timestamp for watermarks; the pattern matches the one table, be it a file or a folder."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]").withColumn(time, F.col(time).cast("timestamp"))
