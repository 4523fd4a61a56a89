"""Per-file analysis. Everything here is a projection: one scan, no shuffle.

A file is one row, so each extractor is an expression over that row and the four
lists of a file come together without a join or a grouping. The tables of single
imports, functions, types or exports are exploded from it and compute only their
own list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import ANALYSIS, FUNCTION
from .languages import LANGUAGES, LanguageExtractor
from .selection import language

PARTS = {"imports": "array<string>", "functions": f"array<{FUNCTION}>", "types": "array<string>", "exports": "array<string>"}


def _by_language(
    path: Column, languages: Sequence[LanguageExtractor], value: Callable[[LanguageExtractor], Column], ddl: str
) -> Column:
    out = F.lit(None).cast(ddl)
    for lang in reversed(languages):
        out = F.when(lang.accepts(path), value(lang)).otherwise(out)
    return out


def _part(lang: LanguageExtractor, part: str, source: Column, body_mode: str) -> Column:
    extract = getattr(lang, part)
    return extract(source, body_mode) if part == "functions" else extract(source)


def analysis(
    path: str = "path",
    content: str = "content",
    body_mode: str = "reference",
    languages: Sequence[LanguageExtractor] = LANGUAGES,
) -> Column:
    """Struct of imports, functions, types and exports of the named columns; null for
    other languages."""
    return _expression(SparkContext._gateway, "analysis", path, content, body_mode, tuple(languages))


@lru_cache(maxsize=256)
def _expression(
    gateway: object, what: str, path: str, content: str, body_mode: str, languages: tuple[LanguageExtractor, ...]
) -> Column:
    """Expression for one list or for the whole analysis.

    Kept, as it takes thousands of calls into the JVM to build and depends on nothing
    but the arguments (``gateway`` is the way to the JVM it lives in, kept so that no later one takes its identity).
    """
    text = F.col(content)
    if what != "analysis":
        return _by_language(
            F.col(path), languages, lambda lang: _part(lang, what, lang.prepare(text), body_mode), PARTS[what]
        )

    def whole(lang: LanguageExtractor) -> Column:
        return let(
            lang.prepare(text), lambda src: F.struct(*[_part(lang, p, src, body_mode).alias(p) for p in PARTS])
        ).cast(ANALYSIS)

    return _by_language(F.col(path), languages, whole, ANALYSIS)


def assemble_analysis(
    files: DataFrame, body_mode: str = "reference", languages: Sequence[LanguageExtractor] = LANGUAGES
) -> DataFrame:
    """One row per file of a known language, also where nothing was found in it."""
    known = files.filter(language(F.col("path"), languages).isNotNull())
    kept = [c for c in files.columns if c != "content"]
    return known.select(*kept, analysis(body_mode=body_mode, languages=languages).alias("analysis"))


def part_table(
    files: DataFrame,
    part: str,
    languages: Sequence[LanguageExtractor] = LANGUAGES,
    body_mode: str = "reference",
) -> DataFrame:
    """path, language, ord (from 1) and the value of one list, from file contents."""
    path = F.col("path")
    values = _expression(SparkContext._gateway, part, "path", "content", body_mode, tuple(languages))
    lists = files.filter(language(path, languages).isNotNull()).select(
        "path",
        language(path, languages).alias("language"),
        values.alias("values"),
    )
    return _explode(lists, part)


def _explode(lists: DataFrame, part: str) -> DataFrame:
    # The outer form: explode() would infer a filter on the list and, pushed below
    # the projection, extract it a second time.
    rows = lists.select("path", "language", F.posexplode_outer("values").alias("pos", "value")).filter("pos IS NOT NULL")
    ordered = rows.withColumn("ord", (F.col("pos") + 1).cast("bigint"))
    if part == "functions":
        return ordered.select("path", "language", "ord", "value.*")
    return ordered.select("path", "language", "ord", F.col("value").alias(part.removesuffix("s")))


def imports(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    return part_table(files, "imports", languages)


def functions(
    files: DataFrame, body_mode: str = "reference", languages: Sequence[LanguageExtractor] = LANGUAGES
) -> DataFrame:
    return part_table(files, "functions", languages, body_mode)


def types(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    return part_table(files, "types", languages)


def exports(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    return part_table(files, "exports", languages)


def explode_analysis(
    analyses: DataFrame, part: str, languages: Sequence[LanguageExtractor] = LANGUAGES
) -> DataFrame:
    """The same table from stored analyses (reads only the list asked for)."""
    lists = analyses.select(
        "path", language(F.col("path"), languages).alias("language"), F.col("analysis")[part].alias("values")
    )
    return _explode(lists, part)


def summary_gate(languages: Sequence[LanguageExtractor] = LANGUAGES) -> Column:
    """Whether a row of a functions table passes its language's gate."""
    row = F.struct("name", "lines_of_code", "cyclomatic_complexity", "parameters", "returns")
    passes = F.lit(False)
    for lang in languages:
        passes = F.when(F.col("language") == lang.name, lang.gate(row)).otherwise(passes)
    return passes


def needs_summary(functions: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    return functions.filter(summary_gate(languages))
