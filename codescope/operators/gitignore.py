"""Ignore files found in the tree, applied in one walk along the sorted paths.

A rule file moves once, to the task that walks past its directory, and once more to each task whose
range begins below it (``intervals``); no rule is copied to a directory or a path.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import gitignore_rule
from ..functions.paths import directory_of, name_of
from .intervals import below, directories_above, walk

# Rule files, the first taking precedence over the second.
RULE_FILES = (".gitignore", ".ignore")
_RULES = T.ArrayType(
    T.StructType().add("regex", "string").add("negated", "boolean").add("directories", "boolean")
)


@F.pandas_udf(_RULES)
def _parse_rules(contents: pd.Series) -> pd.Series:
    keys = ("regex", "negated", "directories")
    return contents.map(
        lambda text: [dict(zip(keys, rule)) for line in text.split("\n") if (rule := gitignore_rule(line))]
    )


def ignore_rules(files: DataFrame) -> DataFrame:
    """dir, rank of the rule file's kind, and its rules in order. Null contents hold no rule."""
    name = name_of(F.col("path"))
    return (
        files.filter(name.isin(*RULE_FILES) & F.col("content").isNotNull())
        .select(
            directory_of(F.col("path")).alias("dir"),
            F.when(name == RULE_FILES[0], 1).otherwise(0).alias("rank"),
            _parse_rules("content").alias("rules"),
        )
        .filter(F.size("rules") > 0)
    )


class _RuleFile:
    """Rules in order; the last that matches decides."""

    def __init__(self, directory: str, rules: list[dict]) -> None:
        self.skip = len(directory) + 1 if directory else 0
        own = [(re.sub(r"\\z\Z", r"\\Z", r["regex"]), r["negated"], r["directories"]) for r in rules]
        # One alternation of all rules settles most paths.
        self.any = re.compile("|".join(f"(?:{regex.removeprefix('(?s)')})" for regex, *_ in own), re.S)
        self.rules = [(re.compile(regex), negated, directories) for regex, negated, directories in reversed(own)]

    def negates(self, entry: str, is_dir: bool) -> bool | None:
        own = entry[self.skip :]
        own = own if self.skip else own.removeprefix("/")
        if self.any.match(own):
            for regex, negated, directories in self.rules:
                if (is_dir or not directories) and regex.match(own):
                    return negated
        return None


class _Directory:
    """A directory on the way down: its own rule files by rank, and how deep the last ignored and code directory are."""

    def __init__(self, path: str, parent: _Directory | None) -> None:
        self.path, self.parent = path, parent
        self.depth = parent.depth + 1 if parent else 0
        self.start = parent.start if parent else -1
        self.files: dict[int, _RuleFile] = {}
        # The nearest directory, this one or above, that has rule files.
        self.ruled = parent.ruled if parent else None
        self.cut = -1
        if parent:
            self.cut = self.depth if parent.ignores(path, True) else parent.cut

    def ignores(self, entry: str, is_dir: bool) -> bool:
        """``.gitignore`` files decide before ``.ignore`` files, deeper ones before higher ones."""
        for rank in (1, 0):
            at = self.ruled
            while at:
                found = at.files[rank].negates(entry, is_dir) if rank in at.files else None
                if found is not None:
                    return not found
                at = at.parent.ruled if at.parent else None
        return False


class _Unignored:
    """Keeps paths that are not ignored, nor below an ignored directory; a code directory starts the walk anew."""

    def __init__(self, inside: bool) -> None:
        self.inside = inside  # only paths below a code directory
        self.way: list[_Directory] = []

    def _enter(self, directory: str, chain: list[str]) -> _Directory:
        while self.way and self.way[-1].path != directory and not below(directory, self.way[-1].path):
            self.way.pop()
        for path in chain[len(self.way) :]:
            self.way.append(_Directory(path, self.way[-1] if self.way else None))
        return self.way[-1]

    def mark(self, row: dict) -> None:
        path = row["dir"]
        own = self._enter(path, [*directories_above(path), path] if path else [""])
        if row["rules"] is None:
            own.start = own.depth
        else:
            own.files[row["rank"]] = _RuleFile(path, row["rules"])
            own.ruled = own

    def keeps(self, path: str) -> bool:
        chain = directories_above(path)
        own = self._enter(chain[-1], chain)
        if own.cut > own.start or (self.inside and own.start < 0):
            return False
        return not own.ignores(path, False)


def unignored_paths(paths: DataFrame, rules: DataFrame, code_dirs: DataFrame | None = None, inside: bool = False) -> DataFrame:
    """The rows of ``paths`` (path) that no rule skips; with ``inside`` only those below a code directory."""
    marks = rules.select("dir", "rank", "rules")
    if code_dirs is not None:
        none = F.lit(None).cast(marks.schema["rules"].dataType).alias("rules")
        marks = marks.unionByName(code_dirs.select("dir", F.lit(2).alias("rank"), none))
    return walk(paths, marks, lambda: _Unignored(inside))


def apply_gitignore(files: DataFrame, rules: DataFrame, code_dirs: DataFrame | None = None) -> DataFrame:
    """Drop files that are ignored, or that lie below an ignored directory.

    With ``code_dirs`` the walk starts at each of those: a file stays if some code
    directory above it is at or below every ignored directory on its path.
    """
    kept = unignored_paths(files.select("path").distinct(), rules, code_dirs)
    return files.join(kept, "path", "left_semi").select(*files.columns)
