import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from codescope.llm import warc


def rows_of():
    rows = [(i, f"http://h{i % 5}.example.com/p/{i}?q={i}#f", f"<p>page {i % 17}\r\n\r\né</p>" * (1 + i % 3), "x") for i in range(90)]
    rows += [(500 + i, "https://hot.example.org/same", f"capture {i}", "x") for i in range(25)]
    rows += [(900, None, None, "x"), (901, "", "", "x"), (902, "no scheme at all\r\nX: y", "", "x"), (None, "http://h.example.com/", "null id", "x"), (903, "http://h.example.com/", "null id", "x"), (904, "HTTP://H.example.COM:80", "z" * 300_000, "x"),
             (905, "http://é.example/ü", "twin", "x"), (905, "http://é.example/ü", "twin", "x")]
    return rows


def brute(rows, least):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        refers = min(same) if same and len(data) >= least and min(same) != page else None
        if page is None and not same:
            refers = None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 40])
def test_every_page_is_read_back(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = rows_of()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, surt string")
    got = warc.archive_and_read_back(spark, pages, least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, map(tuple, got.collect()))) == brute(rows, least)


def test_lookups_read_only_what_is_asked(spark, tmp_path):
    pages = spark.createDataFrame(rows_of(), "page_id long, url string, html string, surt string")
    folder = f"file://{tmp_path}/w"
    parts = warc.write_index(spark, warc.write_archives(spark, pages, folder), folder)
    asked = spark.createDataFrame([("http://h1.example.com/p/1?q=1",), ("https://hot.example.org/same",), ("http://not.there/",)], "url string")
    got = warc.look_up(spark, asked, parts, folder, with_payload=True).collect()
    assert sorted(r.page_id for r in got) == [1, *range(500, 525)]
    assert {bytes(r.payload) for r in got if r.page_id == 510} == {b"capture 10"}
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(rows_of()) and b"\r\nX: y" not in text


def test_keys_and_empty_table(spark):
    assert warc.surt("http://www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.surt("https://example.com") == "com,example)/" and warc.surt(None) == ")/"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read_back(spark, empty).collect() == []


def test_one_key_is_read_back_by_many_tasks(spark, monkeypatch):
    """Every capture has the same key; the planner does not merge the tasks that read."""
    for name, value in (("READ_RECORDS", 50), ("READ_STRETCH", 1000)):
        monkeypatch.setattr(warc, name, value)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.createDataFrame([(k, None, f"<p>{k}</p>") for k in range(600)], "page_id long, url string, html string")
    got = warc.archive_and_read_back(spark, pages)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 600 and len(tasks) >= 6 and max(r["count"] for r in tasks) <= 200
