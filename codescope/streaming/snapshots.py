"""Incremental analysis of a stream of file snapshots (path, last_modified, content).

Spark's file stream reads a path once and does not see edits in place, so the stream
carries snapshot rows; trees on disk are analysed in batches (``plans.analyze_tree``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import assemble_analysis
from ..operators.languages import LANGUAGES, LanguageExtractor
from ..schema import ANALYSIS

_LOG = f"path string, last_modified bigint, analysis {ANALYSIS}"


def read_snapshots(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of snapshot rows from Parquet files dropped into a folder."""
    return (
        spark.readStream.schema("path string, last_modified bigint, content string")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .parquet(folder)
    )


def new_versions(snapshots: DataFrame, delay: str = "1 day") -> DataFrame:
    """Snapshots without repeats of the same path and time within ``delay`` of arrival.

    The watermark runs on arrival, not on the file's own time: a file that is old but
    new to the stream must not be dropped as late. State holds one key per version for
    ``delay``, no contents; a repeat after that is analysed again, to the same result.
    """
    seen = snapshots.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", delay)
    return seen.dropDuplicatesWithinWatermark(["path", "last_modified"])


def stream_analyze(
    snapshots: DataFrame,
    out_path: str,
    checkpoint: str,
    delay: str = "1 day",
    body_mode: str = "reference",
    languages: Sequence[LanguageExtractor] = LANGUAGES,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the analysis of every new version to a log, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so the log
    has each batch once. Nothing written before is read or rewritten.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = assemble_analysis(batch, body_mode, languages).select("path", "last_modified", "analysis")
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = new_versions(snapshots, delay).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_analyses(spark: SparkSession, out_path: str) -> DataFrame:
    """Newest version of each path in the log.

    The newest time per path is found on the key columns; only rows of that time go
    on with their analysis. Where two batches carry the same version they agree.
    """
    log = spark.read.schema(f"{_LOG}, batch bigint").parquet(out_path)
    newest = log.groupBy("path").agg(F.max(F.struct("last_modified", "batch")).alias("k"))
    keys = newest.select("path", F.col("k.last_modified").alias("last_modified"), F.col("k.batch").alias("batch"))
    return log.join(keys, ["path", "last_modified", "batch"]).drop("batch")


def compact(spark: SparkSession, out_path: str, target: str) -> None:
    """Write the newest versions as a fresh table (the log itself stays)."""
    latest_analyses(spark, out_path).write.mode("overwrite").parquet(target)
