"""WARC archives with a two-level capture index: written, indexed and read back by ranges."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import batches_of, salted_join, scratch_folder, write_through

#: A task begins another archive beyond so many bytes.
ARCHIVE_BYTES = 1 << 28
#: Lines of a compressed block of the index.
BLOCK_LINES = 300
#: Parts of the index, each one range of keys; the driver routes by their first keys.
MOST_PARTS = 200_000
#: Bytes and records that a task reads back on average at most, and bytes of an archive whose records are read by one task.
READ_BYTES, READ_RECORDS, READ_STRETCH = 1 << 25, 4096, 1 << 18
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "surt string, page_id long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """The key of a URL: its host's labels reversed, then port, path and query; the scheme and a fragment do not count."""
    m = re.fullmatch(r"(?s)(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?)?([^#]*)(?:#.*)?", url or "")
    host, port, rest = m.groups() if m else (None, None, url or "")
    return ",".join(reversed((host or "").lower().split("."))) + (port or "") + ")" + (rest or "/")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of ``refers_to`` with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record holds; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(found) if (found := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None}


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every row of ``pages`` as a record below ``folder``; returns the captures (surt, page_id, file, offset, length).

    Each record is a gzip member of its own. Of records with equal payloads of at least ``least_bytes`` that with the
    smallest id is the response, the others revisit it. A task that is run again writes new files; only
    those of the run that counts are among the captures. Null payloads are empty, null URLs have the key ")/"; a row
    without an id is a response unless its payload is another's, and is never referred to. Rows that repeat the smallest id are responses.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("digest", F.sha1("html"))
    equal = keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    ready = salted_join(keyed, equal, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, html, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = _member(record(page, url, html.encode(), refers))
                out.write(data)
                rows.append((surt(url), page, name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["surt", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    with batches_of(spark, 500):
        return write_through(spark, ready.mapInArrow(write, _SCHEMA), "captures")


def write_index(spark: SparkSession, captures: DataFrame, folder: str) -> DataFrame:
    """Writes the two-level index below ``folder``; returns its parts (first, last, blocks, directory).

    Captures are sorted by key over the whole corpus; each part is a range. A part's lines go into compressed blocks, one after the
    other in one file, and its directory, a file too, holds each block's first key, place and length.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        stem = f"{path}/cdx-{uuid.uuid4().hex}"
        held, entries, at, last, out = [], [], 0, None, None

        def flush() -> None:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{stem}.gz", compression=None)
            data = _member("".join(json.dumps(x) + "\n" for x in held).encode())
            out.write(data)
            entries.append((held[0][0], at, len(data)))
            at += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                last = row[0]
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{stem}.idx", compression=None) as directory:
                directory.write("".join(json.dumps(e) + "\n" for e in entries).encode())
            name = stem.rpartition("/")[2]
            yield pa.RecordBatch.from_pydict({"first": [entries[0][0]], "last": [last], "blocks": [f"{name}.gz"], "directory": [f"{name}.idx"]})

    order = ["surt", "page_id", "file", "offset"]
    lined = captures.select(*order, "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return write_through(spark, lined.mapInArrow(write, "first string, last string, blocks string, directory string"), "parts")


class _Files:
    """Range reads; a few files stay open."""

    def __init__(self, folder: str) -> None:
        self.store, self.path = _open(folder)
        self.open: dict = {}

    def read(self, name: str, offset: int | None = None, length: int | None = None) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.store.open_input_file(f"{self.path}/{name}")
        file = self.open[name]
        return file.read_at(file.size() if length is None else length, offset or 0)


def look_up(spark: SparkSession, urls: DataFrame, parts: DataFrame, folder: str, url_col: str = "url", with_payload: bool = False) -> DataFrame:
    """The records captured of each distinct key of ``urls``, read from the archives.

    surt, page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]. A key goes to the parts whose range
    holds it; there the directory is searched for its blocks, each block for its lines, and only the records
    found are read, each by its range, by tasks of at most READ_RECORDS records or READ_BYTES bytes on average. A key that was not captured has no row.
    """
    ranges = parts.select("first", "last", "blocks", "directory").limit(MOST_PARTS + 1).collect()
    if len(ranges) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts")
    sent = spark.sparkContext.broadcast(sorted(tuple(r) for r in ranges))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        lasts = [r[1] for r in known]
        for batch in batches:
            keys, to = [], []
            for key in {surt(u) for u in batch["url"].to_pylist()}:
                k = bisect.bisect_left(lasts, key)
                while k < len(known) and known[k][0] <= key:
                    keys.append(key), to.append(k)
                    k += 1
            yield pa.RecordBatch.from_pydict({"surt": pa.array(keys, pa.string()), "part": pa.array(to, pa.int32())})

    names = ["surt", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    types = dict(zip(["surt", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, files = sent.value, _Files(folder)
        part, entries, firsts, block, lines, keys = -1, [], [], None, [], []
        for batch in batches:
            rows = []
            for to, key in zip(batch["part"].to_pylist(), batch["surt"].to_pylist()):
                if to != part:
                    part, block = to, None
                    entries = [json.loads(x) for x in files.read(known[to][3]).splitlines()]
                    firsts = [e[0] for e in entries]
                for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    if block != k:
                        _, at, length = entries[k]
                        lines = [json.loads(x) for x in zlib.decompress(files.read(known[to][2], at, length), 31).splitlines()]
                        block, keys = k, [x[0] for x in lines]
                    rows += [(key, *line[2:]) for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["surt", "file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for batch in batches:
            rows, size = [], 0
            for key, *place in zip(*(batch[c].to_pylist() for c in ("surt", "file", "offset", "length"))):
                found = parse(zlib.decompress(files.read(*place), 31)) | {"surt": key}
                rows.append([found[c] for c in names])
                size += found["payload_bytes"]
                if size > 1 << 24 and with_payload:
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*rows))], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*rows))], names)

    asked = urls.select(F.col(url_col).alias("url")).mapInArrow(route, "surt string, part int").distinct()
    lined = asked.repartition("part", F.pmod(F.xxhash64("surt"), F.lit(8))).sortWithinPartitions("part", "surt")
    places = write_through(spark, lined.select("part", "surt").mapInArrow(locate, "surt string, file string, offset long, length long"), "places")
    # Places are few bytes, whatever they stand for: they are dealt by a stated number of tasks, which the planner does not merge,
    # and by stretches of the archives, so that the records of one key, however many, are not one task's.
    records, size = places.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-records // READ_RECORDS), -(-size // READ_BYTES))
    dealt = places.repartition(tasks, "file", F.floor(F.col("offset") / READ_STRETCH)).sortWithinPartitions("file", "offset")
    schema = "surt string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return dealt.mapInArrow(read, schema)


def archive_and_read_back(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives ``pages``, indexes the captures and reads every record back through the index."""
    folder = scratch_folder(spark, "archives")
    parts = write_index(spark, write_archives(spark, pages, folder, least_bytes), folder)
    return look_up(spark, pages, parts, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
