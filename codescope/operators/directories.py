"""Code directories and membership in them.

These work on key columns: pass ``files`` without its content where the result is
only needed to choose paths (see ``plans``), so that no file content is shuffled.
Membership is found by a walk along the sorted paths (``intervals``), so neither a hot
directory nor the top of the tree is the key of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import below, walk
from .selection import ignore_patterns, is_ignored

# Names that make their directory a code directory.
CODE_IDENTIFIERS = ("Cargo.toml", "package.json", "setup.py", "requirements.txt")


def code_directories(
    files: DataFrame,
    identifiers: Sequence[str] = CODE_IDENTIFIERS,
    custom_ignore: Sequence[str] = (),
    root: str = "",
) -> DataFrame:
    """Directories with an entry of an identifying name, ignored ones left out.

    The entry may itself be a directory, so every component of a path is looked at.
    """
    path = F.col("path")
    parts = F.split(path, "/", -1)
    hits = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.get(parts, i - 1).isin(*identifiers))
    names = "|".join(rf"\Q{name}\E" for name in identifiers)
    named = files.filter(path.rlike(rf"(?s)(?:\A|/)(?:{names})(?:/|\z)"))
    at = named.select("path", F.explode(hits).alias("i"))
    dirs = at.select(F.array_join(F.slice(parts, F.lit(1), F.col("i") - 1), "/").alias("dir")).distinct()
    if root:
        dirs = dirs.filter((F.col("dir") == root) | F.startswith(F.col("dir"), F.lit(root + "/")))
    return dirs.filter(~is_ignored(F.col("dir"), ignore_patterns(custom_ignore), root))


class _Inside:
    """Keeps paths below some marked directory."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def _leave(self, path: str) -> None:
        while self.open and not below(path, self.open[-1]):
            self.open.pop()

    def mark(self, row: dict) -> None:
        self._leave(row["dir"])
        self.open.append(row["dir"])

    def keeps(self, path: str) -> bool:
        self._leave(path)
        return bool(self.open)


def in_code_directory(files: DataFrame, code_dirs: DataFrame) -> DataFrame:
    """Files below some code directory, each row once however many enclose it."""
    inside = walk(files.select("path").distinct(), code_dirs.select("dir"), _Inside)
    return files.join(inside, "path", "left_semi").select(*files.columns)
