"""Analysis cache keyed by path and modification time (whole seconds, equality).

Stored as a log: each run adds what it found as a delta, a compaction folds deltas into a base.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CACHE
from .extract import analysis
from .languages import LANGUAGES, LanguageExtractor
from .selection import language

KEY = ["path", "last_modified"]


def _key(files: DataFrame, cache: DataFrame) -> list[str]:
    """A ``fingerprint`` column on both sides (model, prompt version) joins the key."""
    both = "fingerprint" in files.columns and "fingerprint" in cache.columns
    return KEY + ["fingerprint"] * both


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    key = _key(files, cache)
    return files.select(*key).join(cache, key)


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    key = _key(files, cache)
    return files.join(cache.select(*key), key, "left_anti")


def stale_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries whose file is gone."""
    return cache.join(files.select("path"), "path", "left_anti")


def incremental_analyze(
    files: DataFrame,
    cache: DataFrame,
    body_mode: str = "reference",
    languages: Sequence[LanguageExtractor] = LANGUAGES,
) -> DataFrame:
    """path, last_modified, analysis, cached: stored where unchanged, else extracted.

    One left join on the path; the extraction is an expression of the joined row and
    runs for misses only. Where both tables are bucketed by path (``save_by_path``)
    the join moves neither contents nor stored analyses.
    """
    f, c = files.alias("f"), cache.alias("c")
    same = F.col("c.last_modified") == F.col("f.last_modified")
    for extra in _key(files, cache)[2:]:
        same &= F.col(f"c.{extra}") == F.col(f"f.{extra}")
    hit = F.coalesce(same, F.lit(False))
    fresh = analysis("f.path", "f.content", body_mode, languages)
    return f.join(c, F.col("f.path") == F.col("c.path"), "left").select(
        F.col("f.path"),
        F.col("f.last_modified"),
        F.when(hit, F.col("c.analysis")).otherwise(fresh).alias("analysis"),
        hit.alias("cached"),
    )


def next_cache(
    results: DataFrame,
    cache: DataFrame,
    evict: bool = False,
    languages: Sequence[LanguageExtractor] = LANGUAGES,
) -> DataFrame:
    """Cache after a run: one row per path, entries of vanished files kept by default."""
    known = results.filter(language(F.col("path"), languages).isNotNull())
    fresh = known.select([c for c in ("path", "last_modified", "fingerprint", "analysis") if c in known.columns and c in cache.columns])
    return fresh if evict else fresh.unionByName(stale_cache(results, cache).select(*fresh.columns))


def save_by_path(df: DataFrame, table: str, buckets: int) -> None:
    """Store a table bucketed and sorted by path, for joins on the path without a shuffle.

    Spread over the same number of partitions first, so that each bucket is one file.
    """
    (
        df.repartition(buckets, "path")
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, "path")
        .sortBy("path")
        .saveAsTable(table)
    )


class _Log:
    """Numbered commits of a cache folder: files that appear whole and are never replaced.

    Data lies in folders of unique names; a commit names one. Two writers can never own the same number.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.root = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _file(self, number: int):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{number}.json")

    def read(self, number: int) -> dict | None:
        """The commit, or None while its writer is still at it (on storage where a file is visible before it is whole)."""
        stream = self.fs.open(self._file(number))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else None

    def put(self, number: int, commit: dict) -> bool:
        """Puts the commit unless there is one of that number."""
        text = json.dumps(commit)
        self.fs.mkdirs(self.root)
        if self.fs.getUri().getScheme() == "file":  # a link is made whole, and only where there is none
            own = self.root.toUri().getPath()
            hidden = f"{own}/.{uuid.uuid4().hex}"
            with open(hidden, "w") as f:
                f.write(text)
            try:
                os.link(hidden, f"{own}/{number}.json")
            except FileExistsError:
                return False
            finally:
                os.remove(hidden)
            return True
        try:
            stream = self.fs.create(self._file(number), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def add(self, commit: dict) -> int:
        number = max(self.numbers(), default=0) + 1
        while not self.put(number, commit):
            number += 1
        return number


def _stored(spark: SparkSession, log: _Log) -> tuple[int, str | None, list[tuple[int, str]]]:
    """(newest commit, data of the newest base or None, deltas since then in order)."""
    numbers = log.numbers()
    commits = {}
    base, through = None, 0
    for number in reversed(numbers):  # no commit before a base is read
        commit = log.read(number)
        if commit is None or number <= through:
            continue
        commits[number] = commit
        if commit["kind"] == "base" and base is None:
            base, through = commit["data"], commit["through"]
    deltas = [(n, c["data"]) for n, c in sorted(commits.items()) if c["kind"] == "delta" and n > through]
    return max(numbers, default=0), base, deltas


def _write_data(rows: DataFrame, path: str) -> str:
    name = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{name}")
    return name


def write_analysis_cache(analyses: DataFrame, path: str) -> str:
    """Replace the whole cache by ``analyses``, one row per path; it counts once it is complete. Returns the data's folder."""
    spark = analyses.sparkSession
    log = _Log(spark, path)
    name = _write_data(analyses, path)
    number = max(log.numbers(), default=0) + 1
    while not log.put(number, {"kind": "base", "data": name, "through": number}):
        number += 1
    return f"{path.rstrip('/')}/{name}"


def append_analysis_cache(changed: DataFrame, path: str, removed: DataFrame | None = None) -> int | None:
    """Add a delta: entries of ``changed`` replace those of their paths, paths of ``removed`` go. Nothing else is read or written.

    Returns the number of the commit; None, and no commit, if there is nothing to add. Of two writers the later commit wins a path.
    """
    spark = changed.sparkSession
    rows = changed.select("*", F.lit(False).alias("removed"))
    if removed is not None:
        rows = rows.unionByName(removed.select("path", F.lit(True).alias("removed")), allowMissingColumns=True)
    name = _write_data(rows, path)
    if spark.read.schema(f"{CACHE}, removed boolean").parquet(f"{path.rstrip('/')}/{name}").isEmpty():
        return None
    return _Log(spark, path).add({"kind": "delta", "data": name})


def read_analysis_cache(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the newest base and of the deltas since, the latest of each path; empty where there is no cache.

    Paths of the deltas are taken out of the base by an anti join on the path; a base without deltas is read as it is.
    """
    path = path.rstrip("/")
    _, base, deltas = _stored(spark, _Log(spark, path))
    whole = spark.read.schema(CACHE).parquet(f"{path}/{base}") if base else spark.createDataFrame([], CACHE)
    if not deltas:
        return whole
    read = lambda n, d: spark.read.schema(f"{CACHE}, removed boolean").parquet(f"{path}/{d}").withColumn("commit", F.lit(n))
    rows = reduce(DataFrame.unionByName, [read(n, d) for n, d in deltas])
    newest = rows.groupBy("path").agg(F.max("commit").alias("commit"))
    kept = rows.join(newest, ["path", "commit"]).where("NOT removed").select(whole.columns)
    return whole.join(newest, "path", "left_anti").unionByName(kept) if base else kept


def compact_analysis_cache(spark: SparkSession, path: str) -> int | None:
    """Write base and deltas as one new base. Deltas that others commit meanwhile stay deltas; None if there is none to fold."""
    log = _Log(spark, path)
    through, _, deltas = _stored(spark, log)
    if not deltas:
        return None
    return log.add({"kind": "base", "data": _write_data(read_analysis_cache(spark, path), path), "through": deltas[-1][0] if deltas else through})
