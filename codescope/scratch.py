"""Scratch folder for intermediate tables, on storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: list[str] = []


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's checkpoint folder.

    Only where the session names none and runs on one machine, as in tests, a temporary
    folder takes its place: executors elsewhere could not reach it. Folders are left for
    the cluster's own cleaning of its checkpoint folder.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that every executor can reach")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="codescope-"))
        base = _local[0]
    return f"{base.rstrip('/')}/codescope/{purpose}-{uuid.uuid4().hex}"


def write_through(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once and go on from the written table: cuts lineage, survives executors."""
    folder = scratch_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def write_bucketed(spark: SparkSession, df: DataFrame, purpose: str, keys: list[str], buckets: int) -> Iterator[DataFrame]:
    """The same in buckets by ``keys``, one file each: joins on them do not shuffle it again. Its name in the catalog ends with the block.

    ``df`` is best dealt by the same keys to as many partitions.
    """
    folder = scratch_folder(spark, purpose)
    name = f"codescope_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay, as those of other steps do
