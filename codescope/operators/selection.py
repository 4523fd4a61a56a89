"""Which files count: language, extension, documentation, ignore patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.paths import extension_of, name_of
from .languages import LANGUAGES, LanguageExtractor

# Code extensions, documentation names, default ignore patterns.
CODE_EXTENSIONS = ("rs", "js", "ts", "py")
DOCUMENTATION = r"\.(md|txt|rst)\z"
DEFAULT_IGNORE = (
    "node_modules", "target", "dist", "build", ".git", ".*ignore", "*.log", "*.tmp", "*.temp", "*.swp", "*.bak",
)


def language(path: Column, languages: Sequence[LanguageExtractor] = LANGUAGES) -> Column:
    """Name of the first language that accepts the path's suffix, else null."""
    out = F.lit(None).cast("string")
    for lang in reversed(languages):
        out = F.when(lang.accepts(path), lang.name).otherwise(out)
    return out


def code_files(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    """Files of the default languages' extensions, or of those of ``languages``."""
    own = CODE_EXTENSIONS if languages == LANGUAGES else [s.removeprefix(".") for lang in languages for s in lang.suffixes]
    return files.filter(extension_of(F.col("path")).isin(*own))


def documentation_files(files: DataFrame) -> DataFrame:
    return files.filter(name_of(F.col("path")).rlike(DOCUMENTATION)).select("path")


def unsupported_files(files: DataFrame, languages: Sequence[LanguageExtractor] = LANGUAGES) -> DataFrame:
    return files.filter(language(F.col("path"), languages).isNull())


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per path, the newest where a path was listed more than once.

    All columns travel, so pass paths and times only where contents are not needed yet.
    """
    return files.dropDuplicates(["path"]) if "last_modified" not in files.columns else _newest(files)


def _newest(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c != "path"]
    # The modification time leads; the other columns settle ties the same way on every run.
    order = F.struct("last_modified", *[c for c in rest if c != "last_modified"])
    return files.groupBy("path").agg(F.max(order).alias("_newest")).select(
        *[F.col("path") if c == "path" else F.col("_newest")[c].alias(c) for c in files.columns]
    )


def corpus_file_count(files: DataFrame) -> DataFrame:
    return code_files(files).agg(F.count(F.lit(1)).alias("files"))


def require_nonempty(files: DataFrame) -> bool:
    """True if there is at least one code file (reads no more than it must)."""
    return not code_files(files).select("path").isEmpty()


def ignore_patterns(custom: Sequence[str] = ()) -> tuple[str, ...]:
    """Custom patterns add to the defaults, they never replace them."""
    return (*custom, *DEFAULT_IGNORE)


def is_ignored(path: Column, patterns: Sequence[str], root: str = "") -> Column:
    """A glob matches a path component, or the full path of the entry or of a directory
    between ``root`` and it. Literal regexes, compiled once per task; with a root, the full
    globs are tried on each prefix from it on, if they match any prefix at all."""
    if not patterns:
        return F.lit(False)
    full = "|".join(glob_regex(p, True) for p in patterns)
    ignored = path.rlike(rf"(?s)\A(?:{full})(?:/|\z)")
    if root:
        names = F.split(path, "/", -1)
        prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
        below = F.exists(prefixes, lambda p: (F.length(p) >= len(root)) & p.rlike(rf"(?s)\A(?:{full})\z"))
        ignored = F.when(ignored, below).otherwise(F.lit(False))
    parts = "|".join(glob_regex(p, False) for p in patterns if "/" not in p)
    if parts:
        ignored = path.rlike(rf"(?s)(?:\A|/)(?:{parts})(?:/|\z)") | ignored
    return ignored


def drop_ignored(files: DataFrame, custom: Sequence[str] = (), root: str = "") -> DataFrame:
    return files.filter(~is_ignored(F.col("path"), ignore_patterns(custom), root))
