"""Tables of files, pages and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, split as ``spark.sql.files.*`` of the session say."""
    return spark.read.parquet(path)
