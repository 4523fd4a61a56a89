import hashlib
import random
import re
import time

import pytest

from codescope.llm import pii

FIXED = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(FIXED) for m in re.finditer(p, text or "") if passes(kind, m[0]))


def texts():
    rng = random.Random(2)
    parts = ["a@b.co", "j.d+x%y@mail-1.example.com", "@", ".", "..", "-", "a", "Zz9", " ", "+1 (415) 555-0100", "+", "+4", "(", ")", "1", "12", "255", "256", "999", "1.2.3.4", "192.168.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "378282246310005", "0000", "é", "😀", "٣", "one", "at", "dot", "\n", "x@y", "a@b.c.", "007.08.9.010"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]


def test_plain_spans_equal_the_patterns():
    for text in texts():
        assert pii.detect(text) == brute(text), text
        spans = pii.personal_spans(text)
        assert [s[:3] for s in spans if s[3]] == brute(text)
        assert spans == sorted(spans, key=lambda s: s[:3])


DISGUISED = [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("mail john(at)example.com, ok", "email", "john(at)example.com"),
    ("write jane dot roe at mail dot example dot org please", "email", "jane dot roe at mail dot example dot org"),
    ("JANE AT EXAMPLE DOT COM", "email", "JANE AT EXAMPLE DOT COM"),
    ("x jane_7 at example.com y", "email", "jane_7 at example.com"),
    ("see joe@example dot com", "email", "joe@example dot com"),
    ("аdmіn@exаmple.com!", "email", "аdmіn@exаmple.com"),
    ("to ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("to jo​e@exam­ple.com", "email", "jo​e@exam­ple.com"),
    ("host 192 dot 168 dot 0 dot 17 up", "ip", "192 dot 168 dot 0 dot 17"),
    ("host 10[.]0[.]0[.]7", "ip", "10[.]0[.]0[.]7"),
    ("host one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ("card ４１１１ 1111 1111 １１１１", "card", "４１１１ 1111 1111 １１１１"),
    ("call plus one four one five, double five five zero one double zero.", "phone", "plus one four one five, double five five zero one double zero"),
    ("call +1 (4l5) 555-O1OO now", "phone", "+1 (4l5) 555-O1OO"),
    ("ruf plus vier neun drei null eins zwei drei vier fünf sechs", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
    ("call +１ ４１５ ５５５ ０１００", "phone", "+１ ４１５ ５５５ ０１００"),
]


@pytest.mark.parametrize("text, kind, span", DISGUISED)
def test_disguises_map_back_to_their_source(text, kind, span):
    found = [(pii.KINDS[k], text[a:b]) for a, k, b, plain in pii.personal_spans(text) if not plain]
    assert found == ([(kind, span)] if span else [])


def test_prose_is_left_alone():
    for text in ("Look at the dot on the map at noon.", "She is (at) home. Two or three came.", "Look at example.com or at the point of no return", "one of two dots, three point five", "plus 3 points", "Ellos llegan a las dos, tres o cuatro", "a < b > c"):
        assert pii.personal_spans(text) == []


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "a@" * 200_000, "1" * 400_000, "1." * 200_000, "+1(" * 130_000, " " * 400_000, "one " * 100_000, "a at " * 80_000, "a dot " * 70_000, "(" * 400_000, "l0" * 200_000, "a.b at c dot " * 30_000):
        start = time.perf_counter()
        pii.personal_spans(text)
        assert time.perf_counter() - start < 4, text[:10]


def test_digests_and_redaction(spark):
    rows = [(k, t) for k, t in enumerate([*texts()[:200], *(d[0] for d in DISGUISED), None, "", "plain words"])] + [(None, "a@b.co"), (3, texts()[3])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, start int")
    got = pii.personal_digests(pii.find_personal(spark, docs))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    want = []
    for i, t in rows:
        own, spans = brute(t), pii.personal_spans(t or "")
        line = lambda found: ",".join(f"{pii.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in found)
        want.append((i, *(sum(s[1] == k for s in own) for k in range(4)), hashlib.sha256(line(own).encode()).hexdigest(), line(spans), sum(not s[3] for s in spans)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    clean = {r["doc_id"]: r for r in pii.redacted(spark, docs.where("doc_id >= 200")).collect()}
    assert clean[200]["text"] == "mail <EMAIL> now" and clean[200]["spans"] == "x"
    assert clean[200 + len(DISGUISED)]["text"] is None
    assert pii.find_personal(spark, docs.limit(0)).collect() == []
