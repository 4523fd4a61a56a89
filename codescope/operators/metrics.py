"""Token counters of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_metrics(log: DataFrame) -> DataFrame:
    """Per call: total tokens and tokens per second (null where no time passed)."""
    total = F.col("input_tokens") + F.col("output_tokens")
    return log.withColumn("total_tokens", total).withColumn(
        "tokens_per_second", F.try_divide(total.cast("double"), F.col("duration_s"))
    )


def inference_metrics(log: DataFrame) -> DataFrame:
    """Per model: calls, tokens, seconds and the overall rate."""
    sums = log.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.sum("duration_s").alias("duration_s"),
    )
    return sums.withColumn(
        "tokens_per_second", F.try_divide(F.col("total_tokens").cast("double"), F.col("duration_s"))
    )
