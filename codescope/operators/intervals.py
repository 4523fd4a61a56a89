"""A directory tree as intervals: in the order of their keys, all paths below a directory follow it.

What lies above a path is found by one sort instead of a join on each ancestor: paths and the
directories that matter (marks) are dealt out by ranges of the key, and each task walks its range with
a stack of the directories it is in. A mark that starts in an earlier range and reaches into this
one lies above the range's first key, so each range is given the marks above that key. No ancestor
is exploded for a path, the top directory is the key of no exchange, and a mark's payload moves once, plus
once for each range that begins below it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys a range on average is chosen from, and at most in all: what the driver gets, whatever the number of paths.
SAMPLE_PER_RANGE, SAMPLE = 64, 1 << 16


def order_key(path: Column) -> Column:
    """Paths below a directory follow it at once: its separator comes before every other character."""
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def directories_above(path: str) -> list[str]:
    """The top and every directory above ``path``, outermost first."""
    return ["", *(path[:i] for i, c in enumerate(path) if c == "/" and i)]


def _range_starts(paths: DataFrame, ranges: int) -> list[str]:
    """First paths of all ranges but the first: quantiles of the paths of least hash."""
    own = paths.where("path IS NOT NULL").select("path").orderBy(F.xxhash64("path"), "path").limit(min(SAMPLE_PER_RANGE * ranges, SAMPLE))
    keys = sorted({r["path"].replace("/", "\x00") for r in own.collect()})
    starts = [keys[k * len(keys) // ranges] for k in range(1, ranges)] if keys else []
    return [k.replace("\x00", "/") for k in sorted(set(starts) - set(keys[:1]))]


def walk(paths: DataFrame, marks: DataFrame, visitor: Callable[[], object]) -> DataFrame:
    """The rows (path) of ``paths`` that a visitor keeps.

    ``marks`` are (dir, ...) rows. ``visitor()`` gives an object with ``mark(row)``, called with each mark as a dict before anything
    below it, and ``keeps(path) -> bool``, both in the order of the keys. Null paths are dropped; repeated ones are visited each.
    """
    spark = paths.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = _range_starts(paths, ranges)
    cuts = [s.replace("/", "\x00") for s in starts]

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda key: bisect_right(cuts, key)).astype("int32")

    payload = [c for c in marks.columns if c != "dir"]
    held = F.struct(*payload) if payload else F.struct(F.lit(True).alias("marked"))
    marked = marks.where("dir IS NOT NULL").select(F.col("dir").alias("at"), held.alias("mark"))
    above = [(k + 1, d) for k, s in enumerate(starts) for d in directories_above(s)]  # a path's length for each range
    reaching = marked.join(spark.createDataFrame(above, "part int, at string"), "at").select("part", "at", "mark")
    own = marked.select(range_of(order_key(F.col("at"))).alias("part"), "at", "mark")
    files = paths.where("path IS NOT NULL").select(range_of(order_key(F.col("path"))).alias("part"), F.col("path").alias("at"), F.lit(None).cast(marked.schema["mark"].dataType).alias("mark"))
    entries = own.unionByName(reaching).unionByName(files)
    dealt = entries.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions(order_key(F.col("at")), F.col("mark").isNull())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = visitor()
        for batch in batches:
            found = []
            for at, mark in zip(batch["at"].to_pylist(), batch["mark"].to_pylist()):
                if mark is not None:
                    own.mark({"dir": at, **mark})
                elif own.keeps(at):
                    found.append(at)
            yield pa.RecordBatch.from_pydict({"path": pa.array(found, pa.string())})

    return dealt.select("at", "mark").mapInArrow(visit, "path string")


def below(path: str, directory: str) -> bool:
    return not directory or path.startswith(directory + "/")
