"""Prompt columns over a functions table (path, language, ord, name, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from .languages import LANGUAGES, LanguageExtractor


def with_prompt(functions: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    """Adds ``prompt``; long Rust functions get the one in parts."""
    fields = [F.col(c) for c in ("name", "signature", "types", "body")]
    prompt = F.lit(None).cast("string")
    for lang in languages:
        text = P.build_prompt(lang.name, *fields)
        if lang.name == "rust":
            text = F.when(P.is_large(F.col("lines_of_code")), P.build_large_prompt(*fields)).otherwise(text)
        prompt = F.when(F.col("language") == lang.name, text).otherwise(prompt)
    return functions.withColumn("prompt", prompt)


def prompt_parts(functions: DataFrame) -> DataFrame:
    """path, ord, part (from 1), text: numbered five-line parts of each body."""
    parts = functions.select("path", "ord", F.posexplode_outer(P.prompt_parts(F.col("body"))).alias("part", "text"))
    return parts.filter("part IS NOT NULL").withColumn("part", (F.col("part") + 1).cast("bigint"))
