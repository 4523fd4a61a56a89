import zlib

import numpy as np
import pytest

from codescope.llm import language


def test_predicts_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(spark, docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    labels = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(rows) == set(labels)
    out = [d for d, r in rows.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert sum(rows[d].lang_pred == labels[d] for d in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    confident = sum(rows[d].score for d in out) / len(out)
    assert abs(confident - sum(rows[d].lang_pred == labels[d] for d in out) / len(out)) < 0.08


def test_edges_and_independence(spark):
    rows = [(i, f"the quick brown fox and the dog {i}", "en", 0.5) for i in range(40)] + [(100 + i, f"le renard brun et la chienne été {i}", "fr", 0.5) for i in range(40)]
    rows += [(300, None, "en", 0.1), (301, "", "fr", 0.1), (302, "1234 !?", "fr", 0.1), (303, "the dog", None, 0.1), (None, "la chienne", "en", 0.1), (304, "x" * 300_000, "en", 0.1), (305, "\U0001f600 \U0001f680!", "en", 0.1), (306, "\U00010400", "en", 0.1), (5, rows[5][1], "en", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, k): r for k, r in enumerate(language.identify(spark, docs).collect())}
    by = {d: r for (d, _), r in got.items()}
    assert len(got) == len(rows)
    for d in (300, 301, 302, 305):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[303].lang_pred == "en" and by[306].lang_pred != "und" and by[None].lang_pred == "fr" and by[None].held_out is False
    other = spark.createDataFrame([(d, t, lang if d is not None and zlib.crc32(str(d).encode()) % 5 else "xx", s) for d, t, lang, s in rows if lang], docs.schema)
    again = {r.doc_id: r for r in language.identify(spark, other).collect()}
    assert all(again[d].lang_pred == by[d].lang_pred for d in (0, 1, 2, 100, 101, 102))  # labels of held-out rows change nothing
    kept = language.keep_known(spark, docs)
    assert kept.columns == docs.columns and {300, 301, 302}.isdisjoint(r.doc_id for r in kept.collect())
    empty = docs.limit(0)
    assert language.identify(spark, empty).collect() == [] == language.keep_known(spark, empty).collect()


def test_elastic_net_is_sparse_and_temperature_fits():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 10 + int(rng.integers(50))]), np.array([1.0, 0.1]), k % 2) for k in range(400)]
    w = language.fit_ftrl(rows, 2)
    assert w[0, 0] > 0 > w[1, 0] and (w[100:] == 0).all() and (w[10:60] == 0).mean() > 0.5
    logits = np.array([[4.0, 0.0]] * 100)
    labels = np.array([0] * 75 + [1] * 25)
    t = language.fit_temperature(logits, labels)
    assert language.softmax(logits[:1] / t)[0, 0] == pytest.approx(0.75, abs=0.01)
