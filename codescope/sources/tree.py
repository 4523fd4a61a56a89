"""A source tree on a file system that every executor mounts.

Spark's own file sources leave out names that start with "_" or ".", so directories are opened by tasks
of our own, level by level: the directories found by one round, a written table, are dealt out for the next. Listing
yields paths, times and sizes only; contents are read in a second step, for the paths still wanted by then, in
bins of about equal bytes. The driver opens no directory and holds no path.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..schema import TREE
from ..scratch import scratch_folder

_BATCH = 4096
_BATCH_BYTES = 64 << 20
#: Bytes and files a task reads on average at most.
_TASK_BYTES, _TASK_FILES = 128 << 20, 10_000

_FOUND = f"{TREE}, is_dir boolean"


def skip_pattern(ignore: Sequence[str]) -> str | None:
    """A regular expression for the paths that one of the globs leaves out."""
    parts = "|".join(glob_regex(p, False) for p in ignore if "/" not in p)
    full = "|".join(glob_regex(p, True) for p in ignore)
    return rf"(?s)(?:.*/)?(?:{parts or '(?!)'})\Z|(?:{full})\Z" if ignore else None


def entries_of(directory: str, skip: str | None) -> Iterator[tuple[os.DirEntry, bool]]:
    """Entries of a directory that count, and whether each is a directory; none where it cannot be opened."""
    try:
        with os.scandir(directory) as entries:
            for entry in entries:
                try:
                    if skip and re.match(skip, entry.path):
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        yield entry, True
                    elif entry.is_file(follow_symlinks=False):
                        yield entry, False
                except OSError:
                    continue
    except OSError:
        return


def _open_directories(root: str, skip: str | None, slices: int):
    """Lists the directories of a task and those below them, until it has opened enough; the others are rows, too."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "rel_path", "name", "last_modified", "length", "is_dir"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = deque(path for b in batches for path in b["path"].to_pylist())
        given, opened, rows = len(pending), 0, []
        while pending:
            directory = pending.popleft()
            if opened >= max(given, slices):
                rows.append((directory, None, None, None, None, True))
            else:
                opened += 1
                for entry, is_dir in entries_of(directory, skip):
                    if is_dir:
                        pending.append(entry.path)
                        continue
                    try:
                        stat = entry.stat()
                    except OSError:
                        continue
                    rows.append((entry.path, os.path.relpath(entry.path, root), entry.name, int(stat.st_mtime), stat.st_size, False))
                    if len(rows) >= _BATCH:
                        yield batch(rows)
                        rows = []
            if len(rows) >= _BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return listed


def list_source_tree(spark: SparkSession, root: str, ignore: Sequence[str] = (), slices: int = 64) -> DataFrame:
    """path, rel_path, name, last_modified, length of every regular file below ``root``, as a written table.

    A task is given ``slices`` directories and opens as many at least before it hands the rest on. Directories that match ``ignore`` are not entered; a root that lies in such a directory yields nothing. Symbolic links
    to directories are not followed.
    """
    root = root.rstrip("/") or "/"
    skip = skip_pattern(ignore)
    inside = skip is None or not any(re.match(skip, part) for part in (root, *root.split("/")))
    frontier = spark.createDataFrame([(root,)] * inside, "path string")
    folder, turn, directories = scratch_folder(spark, "tree"), 0, 1
    while directories:
        tasks = max(1, -(-directories // slices))
        found = frontier.repartition(tasks, F.xxhash64("path")).mapInArrow(_open_directories(root, skip, slices), _FOUND)
        found.write.parquet(f"{folder}/round={turn}")
        frontier = spark.read.schema(_FOUND).parquet(f"{folder}/round={turn}").where("is_dir").select("path")
        directories, turn = frontier.count(), turn + 1
    rounds = [f"{folder}/round={k}" for k in range(turn)]
    return spark.read.schema(_FOUND).parquet(*rounds).where("NOT is_dir").drop("is_dir")


def read_contents(listed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``content`` (bytes) and ``io_error`` by reading each path on the executors.

    Listed rows are small, so they are spread first, over as many tasks as their ``length`` and number ask for (where there
    is no length, their number): the planner would merge them by their size, which says nothing of the bytes behind them. A
    file that cannot be read keeps its row, with null content and the reason in ``io_error``. ``listed`` is read twice.
    """
    if partitions is None:
        size = F.coalesce(F.sum("length"), F.lit(0)) if "length" in listed.columns else F.lit(0)
        files, size = listed.agg(F.count("*"), size).first()
        partitions = max(1, -(-files // _TASK_FILES), -(-size // _TASK_BYTES), min(files, listed.sparkSession.sparkContext.defaultParallelism))
    spread = listed.repartition(partitions, F.xxhash64("path"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # A batch of rows may stand for a lot of bytes: it leaves in parts of bounded size.
            start, held, size = 0, [], 0
            for path in frame["path"]:
                held.append(_bytes_of(path))
                size += len(held[-1][0] or b"")
                if size >= _BATCH_BYTES or len(held) == _BATCH:
                    yield _part(frame, start, held)
                    start, held, size = start + len(held), [], 0
            if held:
                yield _part(frame, start, held)

    ddl = ", ".join(f"{name} {kind}" for name, kind in listed.dtypes)
    return spread.mapInPandas(read, f"{ddl}, content binary, io_error string")


def _part(frame: pd.DataFrame, start: int, held: list[tuple[bytes | None, str | None]]) -> pd.DataFrame:
    contents, errors = (pd.Series(c, index=frame.index[start : start + len(held)], dtype=object) for c in zip(*held))
    return frame.iloc[start : start + len(held)].assign(content=contents, io_error=errors)


def _bytes_of(path: str) -> tuple[bytes | None, str | None]:
    try:
        with open(path, "rb") as f:
            return f.read(), None
    except OSError as e:
        return None, e.strerror or str(e)


def read_source_tree(
    spark: SparkSession, root: str, ignore: Sequence[str] = (), slices: int = 64, partitions: int | None = None
) -> DataFrame:
    return read_contents(list_source_tree(spark, root, ignore, slices), partitions)


def rules_above(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """path, content (bytes), io_error of files of these names in the directories above ``root``."""
    above = [root[:i] for i, c in enumerate(root) if c == "/"]
    asked = spark.createDataFrame([(f"{d}/{name}",) for d in above for name in names], "path string")
    return read_contents(asked, 1).where("io_error IS NULL")
