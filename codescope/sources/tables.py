"""File tables from tables: the main route for corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files_from_table(
    df: DataFrame, path: str = "path", modified: str = "last_modified", content: str = "content"
) -> DataFrame:
    """path, last_modified (whole seconds since 1970), content, from any table that has them.

    Binary content stays binary until ``errors.check_files`` has looked at it.
    """
    kind = df.schema[modified].dataType
    seconds: Column = F.col(modified)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_seconds(seconds.cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        seconds = F.unix_seconds(seconds)
    return df.select(
        F.col(path).alias("path"), seconds.cast("bigint").alias("last_modified"), F.col(content).alias("content")
    )


def text_content(files: DataFrame) -> DataFrame:
    """Bytes decoded as UTF-8; null where they are not valid."""
    return files.withColumn("content", F.try_validate_utf8(F.col("content").cast("string")))

