import hashlib
import random
import re
from collections import Counter

import pytest

from codescope.llm import fingerprints

WORDS = [f"w{i}" for i in range(300)]


def likeness_of(a, b):
    a, b = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t) if w) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "STRETCH", 8)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS[: rng.choice([20, 300])]) for _ in range(rng.choice([3, 50, 400]))) for _ in range(40)]
    texts += ["", None, "éà ü\n日本", texts[0], " \t ", "x" * 30_000]
    ids = rng.sample(range(-50, 200), len(texts))
    docs = spark.createDataFrame([(i, t, i, "c") for i, t in zip(ids, texts)], "doc_id long, text string, pos int, stretch string")
    rows = {r.doc_id: r for r in fingerprints.document_fingerprints(spark, docs, samples=64).collect()}
    order = sorted(zip(ids, [t or "" for t in texts]), reverse=True)
    errors = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        errors += [rows[i].near_edited - likeness_of(t, edited), rows[i].near_next - likeness_of(t, following)]
    assert abs(sum(errors) / len(errors)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.08
    assert rows[ids[0]].fingerprint == rows[ids[43]].fingerprint and len(rows[ids[0]].fingerprint) == 256
    assert rows[ids[40]].fingerprint == rows[ids[41]].fingerprint == rows[ids[44]].fingerprint == ""


@pytest.mark.parametrize("spread", ["dense", "spread", "clustered", "one id", "none"])
def test_successors_whatever_the_ids(spark, monkeypatch, spread):
    monkeypatch.setattr(fingerprints, "STRETCH", 8)
    rng = random.Random(6)
    ids = {"dense": range(300), "spread": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)], "clustered": [*range(250), *(rng.randrange(1 << 40, 1 << 60) for _ in range(50))], "one id": [7] * 150 + list(range(100, 250)), "none": [None] * 200 + list(range(100))}[spread]
    rows = [(i, f"t{k} text") for k, i in enumerate(ids)]
    pairs = fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter(r.stretch for r in pairs)
    assert max(sizes.values()) <= 40 and len(sizes) > 10
    line = sorted(pairs, key=lambda r: (-r.stretch, r.pos))
    assert sorted((str(r.doc_id), r.text) for r in line) == sorted((str(i), t) for i, t in rows)
    assert [r.doc_id for r in line] == sorted((i for i in ids if i is not None), reverse=True) + [i for i in ids if i is None]
    for r, following in zip(line, [*line[1:], line[0]]):
        half = len(r.text) // 2
        assert r.edited == r.text[: len(r.text) - half] + following.text[:half]


def test_one_row_repeats_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert fingerprints.document_fingerprints(spark, spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.document_fingerprints(spark, spark.createDataFrame([(5, "a b c d")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = fingerprints.document_fingerprints(spark, spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == [("5", 3), ("5", 3), ("None", 0), ("None", 3)]
