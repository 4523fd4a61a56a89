import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescope.llm import negatives


def brute(rows, asked, positives=5, k=5):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in kept:
        if asked(a):
            near = sorted((-dot(v, w), i) for i, y, w in kept if y == label and i != a and len(w) == len(v))[:positives]
            other = sorted((-dot(v, w), i) for i, y, w in kept if y != label and len(w) == len(v))
            for minus, p in near:
                inside = [(s, i) for s, i in other if 80 * -minus <= 100 * -s <= 100 * -minus][:k]
                out += [(a, p, r, i, -minus, -s) for r, (s, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_ROWS", 16), ("PAIRS", 64), ("ROUND_BYTES", 500)):
            monkeypatch.setattr(negatives, name, value)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([rng.gauss(0, 0.3), 0.25]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rng.randrange(2), [0.5] * 6) for i in range(60)]  # one very common vector
    rows += [(20, 1, [0.4] * 6), (20, 1, [0.4] * 6), (300, 0, None), (310, None, [0.1] * 6), (None, 0, [0.1] * 6), (320, 0, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (330, 0, [float("nan")] * 6), (340, 1, [float("-inf")] * 6)]
    rows += [(350, 1, [1.0, 2.0]), (360, 1, [1.0, -2.0]), (370, 2, [0.9, 1.9]), (380, 0, []), (390, 0, []), (400, 1, []), (410, 2, [1e5, -1e5] * 3), (411, 2, [1e5, -1e5] * 3), (412, 1, [1e5, -1e5] * 3)]
    rows += [(i, 9, [rng.gauss(0, 1) for _ in range(70)]) for i in range(500, 520)] + [(i, 8, [rng.gauss(0, 1) for _ in range(70)]) for i in range(520, 560)]
    table = spark.createDataFrame([(i, y, v, 1, "x") for i, y, v in rows], "vec_id long, label int, embedding array<double>, tile int, slot string")
    got = negatives.mine_hard_negatives(spark, negatives.labelled(table), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a % 10 == 0)


def test_intervals_hold_every_product_and_leave_rows_out():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 64, 100):
        rows, own = rng.integers(-90, 90, (400, dim)), rng.integers(-90, 90, (30, dim))
        low, high = negatives.Asked(np.arange(30), np.zeros(30), own).interval(slice(0, 30), *negatives.encode(rows))
        exact = own @ rows.T
        assert (low <= exact).all() and (exact <= high).all()
        if dim == 64:
            top = np.sort(exact, axis=1)[:, -5]
            assert (high >= top[:, None]).mean() < 0.5


def test_empty_and_single_tables(spark):
    one = negatives.labelled(spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>"))
    for rows in (one, one.limit(0)):
        assert negatives.mine_hard_negatives(spark, rows, F.col("vec_id") % 100 == 0).collect() == []
