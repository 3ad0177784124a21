"""A corpus from any table that has a path and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_from_table(df: DataFrame, path: str, content: str) -> DataFrame:
    """Map columns to (path, size_bytes, content); the size is that of the text."""
    return df.select(
        F.replace(F.col(path), F.lit("\\"), F.lit("/")).alias("path"),
        F.octet_length(F.col(content)).cast("bigint").alias("size_bytes"),
        F.col(content).alias("content"),
    )
