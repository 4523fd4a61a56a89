import math
import random

import pytest

from codescope.llm import topk


def brute(rows, k, asked):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in kept:
        if asked(q):
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(spark, monkeypatch, k):
    for name, value in (("QUERY_BLOCK", 7), ("ROW_BLOCK", 16), ("BINS", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(k)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.25]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # one very common vector
    rows += [(300, None), (301, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.1] * 6), (310, [1.0, 2.0]), (320, [1.0, -2.0]), (330, []), (340, [3.0, 1.0, 1.0]), (350, [1e9, -1e9] * 3)]
    vectors = topk.quantised(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, dim int"))
    got = topk.top_k(spark, vectors, vectors.where("vec_id % 10 = 0"), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, k, lambda q: q % 10 == 0)


def test_rounds_count_no_score_above_the_chosen_bin(spark):
    assert topk.BINS == 64
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(4000)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(spark, vectors, vectors.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda q: q % 50 == 0)


def test_empty_tables(spark):
    vectors = topk.quantised(spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.top_k(spark, vectors, vectors).collect() == []
    assert topk.top_k(spark, vectors.limit(0), vectors.limit(0)).collect() == []
