import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codescope.llm import common, ngram_join, shingles
from codescope.scratch import write_bucketed


def sets_of(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(ids, texts, words, percent):
    sets = sets_of(texts, words)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, d in enumerate(ids))


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    passage = " ".join(word() for _ in range(12))
    bases = [[word() for _ in range(rng.choice([2, 5, 30, 80]))] for _ in range(12)]
    texts = ["", None, "one", "One", "two words", " \n\t ", "É é ẞ x y z", "x" * 5000]
    while len(texts) < n:
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += passage.split()
        sep = rng.choice([" ", "  ", "\n", "\t"])
        t = sep.join(w)
        texts.append(t.upper() if rng.random() < 0.1 else t)
    return texts


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, words, percent, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 600)  # several tiles for one list
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in zip(ids, texts)], "doc_id long, text string, list string, n int")
    got = ngram_join.ngram_join(spark, docs, words, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(ids, texts, words, percent)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert ngram_join.ngram_join(spark, spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (5, None), (6, "")]
    got = ngram_join.ngram_join(spark, spark.createDataFrame(rows, schema))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, 2, None), (4, 2, 4), (4, 2, 4), (9, 2, 4), (5, 0, 5), (6, 0, 6)]))
    kept = ngram_join.keep_one(spark, spark.createDataFrame(rows, schema))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[5]]))


def test_forest_spans_components_without_all_pairs():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    sets = [base] + [np.unique(np.concatenate([np.delete(base, rng.integers(0, len(base), 4)), rng.integers(0, 1 << 60, 4, dtype=np.uint64)])) for _ in range(60)]
    edges = list(ngram_join.t_occurrence(sets, [0] * len(sets), 90))
    assert len(edges) == len(sets) - 1


def test_sets_do_not_depend_on_batches():
    texts = corpus(9, 60)
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts), 3)]
    single = [next(iter(shingles.shingle_sets(pa.array([t]), 3))).tolist() for t in texts]
    assert whole == single == [s.tolist() for s in shingles.shingle_sets(pa.array(["pad", *texts])[1:], 3)]
    assert [len(s) for s in whole] == [len(s) for s in sets_of(texts, 3)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bitmaps_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    sets, labels = [], []
    for _ in range(12):
        base = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 900)), dtype=np.uint64))
        for _ in range(5):
            gone = rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) * (100 - percent) // 100)))
            sets.append(np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 1 << 64, int(rng.integers(0, 1 + len(base) // 8)), dtype=np.uint64)])))
            labels.append(int(rng.integers(0, 4)))
    roles = rng.integers(1, 3, len(sets))
    for role in (np.zeros(len(sets), int), roles):
        may = ngram_join.plausible(np.array([len(s) for s in sets]), np.array(labels), role, [ngram_join.bitmap(s) for s in sets], percent)
        for i, a in enumerate(sets):
            partners = [j for j, b in enumerate(sets) if labels[i] != labels[j] and (role[i] == 0 or role[i] + role[j] == 3) and len(a) and len(b) and ngram_join.links(len(a), len(b), len(np.intersect1d(a, b)), percent)]
            assert may[i] or not partners
    assert 0 < may.sum() < len(sets)


@pytest.mark.parametrize("kind", ["int32", "int64", "uint8"])
def test_chunks_of_small_numbers_are_small_and_fold_to_their_sum(spark, kind):
    rng = np.random.default_rng(3)
    low = 0 if kind == "uint8" else -3
    parts = [rng.integers(low, 4, 1 << 14).astype(kind) for _ in range(3)]
    if kind != "uint8":
        parts[0][5:8] = np.iinfo(kind).min, np.iinfo(kind).max - 9, -70000
    rows = [(k, part) for a in parts for k, part in common.split_chunks(a, 4)]
    assert sum(len(part) for _, part in rows) < 3 * (1 << 14) * 0.6
    frame = spark.createDataFrame([(k, bytearray(part)) for k, part in rows], "chunk int, part binary")
    op = np.bitwise_or if kind == "uint8" else np.add
    total = common.fold_chunks(spark, frame, 4, kind, 1 << 14, op)
    assert total.dtype == kind and (total == op(op(parts[0], parts[1]), parts[2])).all()


def test_bucketed_tables_are_joined_without_another_shuffle(spark):
    sets = spark.range(1000).selectExpr("id s1", "id % 7 s2", "uuid() shingles").repartition(4, "s1", "s2")
    groups = spark.range(500).selectExpr("id g1", "id * 2 s1", "id * 2 % 7 s2")
    with write_bucketed(spark, sets, "sets", ["s1", "s2"], 4) as table:
        name = table.inputFiles()
        joined = groups.join(table.hint("merge"), ["s1", "s2"])
        assert joined._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the groups only
        assert joined.count() == 500 and len(name) <= 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codescope_")]


def test_sets_that_meet_in_many_lists_are_sent_once(spark, monkeypatch):
    """Thirty sets in twenty lists were six hundred whole sets of shingles; a cluster larger than its tiles allow keeps its lists."""
    rows = [(g, 0, 0, 0, s, -s, 0, 10, 1, -1) for g in range(20) for s in range(1, 31)]
    rows += [(g, 0, 0, 0, s, -s, 0, 10, 100, -100) for g in (50, 51) for s in range(100, 130)]
    found = spark.createDataFrame(rows, "g1 long, g2 long, lo int, hi int, s1 long, s2 long, role int, n long, t1 long, t2 long")
    classes = spark.createDataFrame([(s, -s, s) for s in [*range(1, 31), *range(100, 130)]], "s1 long, s2 long, class long")
    sent = ngram_join._met_once(spark, found, classes).collect()
    assert sorted(r["s1"] for r in sent) == [*range(1, 31), *range(100, 130)]
    assert {(r["g1"], r["role"]) for r in sent} == {(1, 0), (100, 0)}
    monkeypatch.setattr(ngram_join, "BLOCK", 60)  # five blocks: five tiles a set, where it had two lists
    sent = [r for r in ngram_join._met_once(spark, found, classes).collect() if r["s1"] >= 100]
    assert len(sent) == 60 and {r["g1"] for r in sent} == {50, 51}
