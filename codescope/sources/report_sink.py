"""The report as files that appear at once: a data source whose write is committed as a whole.

Tasks write parts to a folder of their attempt. Only the commit names them, in order, in a manifest that replaces the
one before; until then, and after an abort, readers see the report as it was.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


@dataclass
class Part(WriterCommitMessage):
    task: int
    file: str
    lines: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target = options["path"].rstrip("/")
        self.attempt = f"parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        """One part: the text of the task's rows, one after the other. A task that is run again writes another file."""
        task = TaskContext.get().partitionId()
        folder = f"{self.target}/{self.attempt}"
        os.makedirs(folder, exist_ok=True)
        name, lines = f"{self.attempt}/{task:06d}-{uuid.uuid4().hex}.md", 0
        with open(f"{self.target}/{name}", "w", encoding="utf-8", newline="") as out:
            for row in iterator:
                out.write(row["text"])
                lines += row["text"].count("\n")
        return Part(task, name, lines)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.task)
        hidden = f"{self.target}/.{self.attempt}"
        with open(hidden, "w") as f:
            json.dump([[p.file, p.lines] for p in parts], f)
        before = _manifest(self.target)
        os.replace(hidden, f"{self.target}/{MANIFEST}")
        for folder in {f.partition("/")[0] for f, _ in before} - {self.attempt}:
            shutil.rmtree(f"{self.target}/{folder}", ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(f"{self.target}/{self.attempt}", ignore_errors=True)


class ReportSink(DataSource):
    """Format ``report``: rows with a column ``text`` of whole lines; option ``path``, a folder that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options))


def _manifest(target: str) -> list[tuple[str, int]]:
    try:
        with open(f"{target}/{MANIFEST}") as f:
            return [(file, lines) for file, lines in json.load(f)]
    except FileNotFoundError:
        return []


def publish_report(blocks: DataFrame, target: str) -> str:
    """Write the ``blocks`` of a report in order; ``target`` shows the new report once it is complete.

    Sorted by ranges, so every task writes a stretch of the report; no task holds more than its range.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(ReportSink)
    target = target.removeprefix("file://").rstrip("/")
    os.makedirs(target, exist_ok=True)
    blocks.orderBy("section_ord", "path", "text").select("text").write.format("report").mode("append").option("path", target).save()
    return target


def read_report(spark: SparkSession, target: str) -> DataFrame:
    """(number, line) of a published report, numbered from 1; parts are read by a task each."""
    target = target.removeprefix("file://").rstrip("/")
    rows, first = [], 1
    for file, lines in _manifest(target):
        rows.append((file, first))
        first += lines
    parts = spark.createDataFrame(rows, "file string, first long").repartition(max(1, len(rows)), F.col("first"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, number in zip(frame["file"], frame["first"]):
                with open(f"{target}/{file}", encoding="utf-8", newline="") as text:
                    held = []
                    for k, line in enumerate(_lines(text)):
                        held.append((number + k, line))
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=["number", "line"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["number", "line"])

    return parts.mapInPandas(read, "number long, line string")


def _lines(text) -> Iterator[str]:
    """Lines that end at a line feed and nothing else."""
    rest = ""
    while block := text.read(1 << 20):
        *whole, rest = (rest + block).split("\n")
        yield from whole
    if rest:
        yield rest
