"""Function summaries from a user-supplied function, called in batches on executors."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import provider_prompt
from ..functions.text import token_count
from ..scratch import write_through
from .extract import summary_gate
from .languages import LANGUAGES, LanguageExtractor
from .prompts import with_prompt
from .spread import spread_join

Summarizer = Callable[[list[str]], list[str]]
_ANSWERS = "prompt_id string, prompt string, summary string, duration_s double, error string"
_STORED = f"{_ANSWERS}, model string"


def first_line_summary(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the prompt's signature line."""
    marked = [p.split("\nSignature: ", 1) for p in prompts]
    return [m[1].split("\n", 1)[0] if len(m) == 2 else "" for m in marked]


def answer_prompts(
    prompts: DataFrame, summarizer: Summarizer, batch_size: int = 32, attempts: int = 1, keep_errors: bool = False
) -> DataFrame:
    """prompt_id, prompt -> answers. Rows leave in batches, each timed as one call.

    A batch that fails is asked ``attempts`` times; then it stops the job, or, with ``keep_errors``, its rows have no summary
    and the reason in ``error``.
    """

    def asked(texts: list[str]) -> tuple[list[str | None], str | None]:
        for left in reversed(range(attempts)):
            try:
                answers = summarizer(texts)
                if len(answers) != len(texts):
                    raise ValueError(f"{len(texts)} prompts, {len(answers)} answers")
                return answers, None
            except Exception as e:
                if not left and not keep_errors:
                    raise
                error = f"{type(e).__name__}: {e}"
        return [None] * len(texts), error

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                began = time.monotonic()
                answers, error = asked(part["prompt"].tolist())
                spent = (time.monotonic() - began) / len(part)
                yield part.assign(summary=pd.Series(answers, index=part.index, dtype=object), duration_s=spent, error=error)

    return prompts.select("prompt_id", "prompt").mapInPandas(call, _ANSWERS)


def stored_answers(spark: SparkSession, store: str, model: str) -> DataFrame:
    """prompt_id, summary of every prompt that ``model`` has answered in a run that used the store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/answers")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "prompt_id string, summary string")
    rows = spark.read.schema(_STORED).option("recursiveFileLookup", "true").parquet(f"{store.rstrip('/')}/answers")
    own = rows.filter((F.col("model") == model) & F.col("error").isNull() & F.col("summary").isNotNull())
    return own.groupBy("prompt_id").agg(F.min("summary").alias("summary"))  # two runs at once may both have asked


def failed_answers(spark: SparkSession, store: str, model: str) -> DataFrame:
    """prompt_id, prompt, error of prompts that failed and that no run has answered since; the next run asks them again."""
    done = stored_answers(spark, store, model).select("prompt_id")
    rows = spark.read.schema(_STORED).option("recursiveFileLookup", "true").parquet(f"{store.rstrip('/')}/answers")
    failed = rows.filter((F.col("model") == model) & F.col("error").isNotNull()).join(done, "prompt_id", "left_anti")
    return failed.groupBy("prompt_id").agg(F.first("prompt").alias("prompt"), F.max("error").alias("error"))


def summarize(
    functions: DataFrame,
    summarizer: Summarizer,
    model: str = "",
    batch_size: int = 32,
    languages: Sequence[LanguageExtractor] = LANGUAGES,
    partitions: int | None = None,
    store: str | None = None,
    attempts: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(functions with ``summary``, log of calls).

    With a ``store``, answers are kept there by prompt and model: a prompt that any run has had answered is not sent
    again. A batch that fails ``attempts`` times is then a row of ``failed_answers`` and leaves its functions without a summary; without
    a store it stops the run.

    ``functions`` is read twice, so pass stored rows rather than an extraction where
    they are at hand. Only functions that pass their language's gate are asked about, and each distinct
    prompt once. The answers are written to the shared scratch folder before use:
    both results read them, and neither a second read nor a lost executor may ask a
    finished batch again. Calls run in ``partitions`` tasks, as many as cores if not given: the
    planner must not merge them for their few bytes.
    """
    spark = functions.sparkSession
    # Rows that need no summary get a key of their own rather than a shared null, which
    # would send them all to one task.
    prompt = provider_prompt(F.col("prompt"))
    own_key = F.concat(F.lit("-"), F.xxhash64("path", "ord").cast("string"))
    asked = with_prompt(functions, languages).withColumn("_ask", summary_gate(languages))
    keyed = asked.withColumn("prompt_id", F.when(F.col("_ask"), F.sha2(prompt, 256)).otherwise(own_key))
    distinct = keyed.filter("_ask").groupBy("prompt_id").agg(F.first(prompt).alias("prompt"))
    distinct = distinct.repartition(partitions or spark.sparkContext.defaultParallelism, "prompt_id")
    if store is None:
        answers = write_through(spark, answer_prompts(distinct, summarizer, batch_size, attempts), "answers")
        summaries = answers
    else:
        known = write_through(spark, stored_answers(spark, store, model), "known-answers")
        new = distinct.join(known, "prompt_id", "left_anti").repartition(partitions or spark.sparkContext.defaultParallelism, "prompt_id")
        folder = f"{store.rstrip('/')}/answers/run-{uuid.uuid4().hex}"
        answer_prompts(new, summarizer, batch_size, attempts, keep_errors=True).withColumn("model", F.lit(model)).write.parquet(folder)
        answers = spark.read.schema(_STORED).parquet(folder).filter("error IS NULL")
        summaries = known.unionByName(answers.select("prompt_id", "summary"))
    # One prompt may stand for a third of all functions, as with vendored copies.
    summaries = summaries.select("prompt_id", F.col("summary").alias("_summary"))
    done = spread_join(keyed, summaries, "prompt_id").withColumn("summary", F.col("_summary"))
    log = answers.select(
        F.col("prompt_id").alias("call_id"),
        F.lit(model).alias("model"),
        "duration_s",
        token_count(F.col("prompt")).alias("input_tokens"),
        token_count(F.col("summary")).alias("output_tokens"),
    )
    return done.select(*functions.columns), log
