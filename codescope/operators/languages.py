"""Registry of languages: which paths they accept and how they read a file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import javascript_source, python_source, rust_source

Extract = Callable[[Column], Column]


def _same(content: Column) -> Column:
    return content


@dataclass(frozen=True)
class LanguageExtractor:
    """Column functions for one language.

    ``prepare`` turns the content into what the four extractors read (bound once per
    file); ``functions`` also takes the body mode. ``gate`` tells from a function
    struct whether it is worth a summary.
    """

    name: str
    suffixes: tuple[str, ...]
    imports: Extract
    functions: Callable[[Column, str], Column]
    types: Extract
    exports: Extract
    gate: Extract
    prepare: Extract = _same

    def accepts(self, path: Column) -> Column:
        return reduce(Column.__or__, [F.endswith(path, F.lit(s)) for s in self.suffixes])


def _longer_than_six(f: Column) -> Column:
    return f["lines_of_code"] > 6


RUST = LanguageExtractor(
    "rust", (".rs",), rust_source.imports_of, rust_source.functions_of, rust_source.types_of, rust_source.exports_of,
    lambda f: F.lit(True), rust_source.items,
)
JAVASCRIPT = LanguageExtractor(
    "javascript", (".js", ".ts"), javascript_source.imports, javascript_source.functions, javascript_source.types,
    javascript_source.exports, _longer_than_six,
)
PYTHON = LanguageExtractor(
    "python", (".py",), python_source.imports, python_source.functions, python_source.types, python_source.exports,
    _longer_than_six,
)
LANGUAGES = (RUST, JAVASCRIPT, PYTHON)
