"""Files that cannot be analysed, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rust_source import is_balanced
from .languages import LANGUAGES, LanguageExtractor
from .selection import language

# Error kinds and their wording.
NO_ANALYZER = "No suitable analyzer found for file: "
BAD_TEXT = "stream did not contain valid UTF-8"
BAD_BRACKETS = "unbalanced brackets"


def _error(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> Column:
    """Struct of kind and message, null for a good file. ``content`` may be text or bytes;
    a column ``io_error`` holds why a file could not be read."""
    path, content = F.col("path"), F.col("content")
    binary = dict(files.dtypes)["content"] == "binary"
    bad_text = ~F.is_valid_utf8(content.cast("string")) if binary else F.lit(False)
    text = F.try_validate_utf8(content.cast("string")) if binary else content
    lang = language(path, languages)
    unread = F.col("io_error") if "io_error" in files.columns else F.lit(None).cast("string")

    def error(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"))

    return (
        F.when(lang.isNull(), error("AnalysisError", F.concat(F.lit(NO_ANALYZER), path)))
        .when(unread.isNotNull(), error("IoError", unread))
        .when(bad_text, error("IoError", F.lit(BAD_TEXT)))
        .when((lang == "rust") & ~is_balanced(text), error("AnalysisError", F.lit(BAD_BRACKETS)))
    )


def with_errors(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    """``files`` with ``error`` (kind, message), null for good ones, and their content as text."""
    marked = files.withColumn("error", _error(files, languages)).drop("io_error")
    return marked.withColumn("content", F.when(F.col("error").isNull(), F.col("content").cast("string")))


def analysis_errors(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    """path, kind, message of every file that cannot be analysed."""
    found = files.select("path", _error(files, languages).alias("error"))
    return found.filter("error IS NOT NULL").select("path", "error.*")


def check_files(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """Good files with text content. ``fail`` stops the job at the first bad one,
    ``quarantine`` leaves bad ones out (``analysis_errors`` lists them)."""
    error = _error(files)
    marked = files.withColumn("_error", error)
    if on_error == "fail":
        stop = F.raise_error(F.concat_ws(": ", F.col("_error.kind"), F.col("path"), F.col("_error.message")))
        good = marked.filter(F.when(F.col("_error").isNull(), F.lit(True)).otherwise(stop.cast("boolean")))
    else:
        good = marked.filter("_error IS NULL")
    return good.drop("_error", "io_error").withColumn("content", F.col("content").cast("string"))
