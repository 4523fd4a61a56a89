"""A source tree as a stream: every file that is new or was edited since the listing before is a row.

Spark's file stream reads a path once and does not see edits in place. Here an offset is a listing (path, time in
nanoseconds, size), kept as a file beside the stream's checkpoint; a batch is the difference of two
listings. A batch that is run again after a failure reads the same two listings, hence the same paths.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schema import FILES
from ..sources.tree import entries_of, skip_pattern

#: Bytes and files of a partition of a batch, at most (or one file).
_BIN_BYTES, _BIN_FILES = 64 << 20, 1000


class Bin(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.state = options["listings"]
        self.skip = skip_pattern([p for p in options.get("ignore", "").split("\n") if p])
        suffixes = [s for s in options.get("suffixes", "").split(",") if s]
        self.suffixes = tuple(suffixes) or ("",)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _listing(self, number: int) -> dict[str, tuple[int, int]]:
        if number == 0:
            return {}
        rows = pq.read_table(f"{self.state}/{number}.parquet").to_pydict()
        return dict(zip(rows["path"], zip(rows["modified"], rows["length"])))

    def _now(self) -> dict[str, tuple[int, int]]:
        found, pending = {}, deque([self.root])
        while pending:
            for entry, is_dir in entries_of(pending.popleft(), self.skip):
                if is_dir:
                    pending.append(entry.path)
                elif entry.name.endswith(self.suffixes):
                    try:
                        stat = entry.stat()
                    except OSError:
                        continue
                    found[entry.path] = (stat.st_mtime_ns, stat.st_size)
        return found

    def latestOffset(self) -> dict:
        """The number of the newest listing; a new one only if the tree is not as it was then."""
        os.makedirs(self.state, exist_ok=True)
        last = max((int(f.removesuffix(".parquet")) for f in os.listdir(self.state) if f.endswith(".parquet") and f[0].isdigit()), default=0)
        found = self._now()
        if found == self._listing(last):
            return {"listing": last}
        rows = {"path": list(found), "modified": [m for m, _ in found.values()], "length": [n for _, n in found.values()]}
        kinds = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("length", pa.int64())])
        hidden = f"{self.state}/.{last + 1}-{os.getpid()}"
        pq.write_table(pa.table(rows, kinds), hidden)
        os.replace(hidden, f"{self.state}/{last + 1}.parquet")  # whole or not at all
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before = self._listing(start["listing"])
        bins: list[list[tuple[str, int]]] = []
        size = 0
        for path, (modified, length) in sorted(self._listing(end["listing"]).items()):
            if before.get(path) == (modified, length):
                continue
            if not bins or size + length > _BIN_BYTES or len(bins[-1]) == _BIN_FILES:
                bins.append([])
                size = 0
            bins[-1].append((path, modified))
            size += length
        return [Bin(files) for files in bins] or [Bin([])]

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        for path, modified in partition.files:
            try:
                with open(path, "rb") as f:
                    content = f.read().decode()
            except (OSError, UnicodeDecodeError):
                continue  # gone again, or no text: whole runs (``plans``) report such files
            yield pa.RecordBatch.from_pydict({"path": [path], "last_modified": [modified // 10**9], "content": [content]})

    def commit(self, end: dict) -> None:
        """Listings before the one that was committed are not asked for again."""
        for name in os.listdir(self.state):
            if name.endswith(".parquet") and name[0].isdigit() and int(name.removesuffix(".parquet")) < end["listing"]:
                os.remove(f"{self.state}/{name}")


class TreeStream(DataSource):
    """Format ``source_tree``: options ``path``, ``listings`` (a folder of its own), ``ignore`` (globs, one per line), ``suffixes``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(dict(self.options))


def stream_source_tree(spark: SparkSession, root: str, listings: str, ignore: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """Stream of path, last_modified, content: files of ``root`` as they appear and change, those there at the start first.

    ``listings`` is a folder that belongs to one stream, as its checkpoint does. One process lists the tree for each batch: names,
    times and sizes; contents are read by tasks, in bins of bounded bytes.
    """
    spark.dataSource.register(TreeStream)
    reader = spark.readStream.format("source_tree").option("path", root).option("listings", listings)
    return reader.option("ignore", "\n".join(ignore)).option("suffixes", ",".join(suffixes)).load()
