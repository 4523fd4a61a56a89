"""Helpers shared by the operators: worker-side code, joins on hot keys, scratch tables."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.scratch import scratch_folder, write_through

__all__ = ["batches_of", "fold_chunks", "salted_join", "scratch_folder", "split_chunks", "write_through"]

# Functions run on executors travel with their code: workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def salted_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``big`` joined with ``small`` on ``on``; a key's rows of ``big`` spread over ``salts`` partitions.

    ``small`` holds one row per key and is repeated ``salts`` times, so a key with a third of all
    rows of ``big`` is not one task's work. Null keys match nothing and spread as well.
    """
    spread = [F.col(c) for c in big.columns if c != on] or [F.col(on)]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def _packed(part: np.ndarray) -> bytes:
    """Whole numbers by places of their bytes, small ones of either sign as small, compressed: most of those bytes are zero."""
    if part.dtype.kind == "i":
        part = (part << 1) ^ (part >> (8 * part.itemsize - 1))
    return zlib.compress(part.view(np.uint8).reshape(-1, part.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(f"u{kind.itemsize}")
    return ((values >> 1) ^ -(values & 1)).view(kind) if kind.kind == "i" else values.view(kind)


def split_chunks(array: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes]]:
    """The array's non-zero stretches, numbered and packed for ``fold_chunks``."""
    for k, part in enumerate(np.split(array, chunks)):
        if part.any():
            yield k, _packed(part)


def fold_chunks(spark: SparkSession, rows: DataFrame, chunks: int, dtype: str, size: int, op: Callable) -> np.ndarray:
    """Folds (chunk int, part binary) rows of all tasks into one array of ``size`` entries.

    The array's size is fixed, whatever the number of rows: that is all the driver gets.
    """
    step = size // chunks

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch["chunk"].to_pylist(), batch["part"]):
                values = _unpacked(part.as_py(), dtype)
                sums[k] = op(sums[k], values) if k in sums else values
        for k, values in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": pa.array([_packed(values)], pa.binary())})

    total = np.zeros(size, dtype)
    folded = rows.select("chunk", "part").repartition("chunk").mapInArrow(fold, "chunk int, part binary")
    for row in folded.collect():
        at = row["chunk"] * step
        total[at : at + step] = op(total[at : at + step], _unpacked(row["part"], dtype))
    return total


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions hand wide rows to workers in Arrow batches of at most ``rows``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
