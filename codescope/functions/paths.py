"""Path expressions. Directories are written without a final slash; the top is ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def extension_of(path: Column) -> Column:
    """Text after the last dot of the name; none for a name whose only dot is first."""
    return F.regexp_extract(name_of(path), r"(?s)\A.+\.([^.]*)\z", 1)


def depth_of(directory: Column) -> Column:
    return F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/", -1)))


def ancestors_of(directory: Column) -> Column:
    """The top, every directory above, and the directory itself."""
    parts = F.split(directory, "/", -1)
    chain = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.array_distinct(F.concat(F.array(F.lit("")), chain))


def top_directory_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.lit(""))
