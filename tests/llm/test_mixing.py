import math
import re
from collections import defaultdict

import pytest

from codescope.llm import mixing


def test_exponent_meets_the_targets():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    a = mixing.fit_exponent(shares, repeats=2.0)
    assert mixing.most_repeats(shares, a) == pytest.approx(2.0, abs=1e-6)
    h = mixing.fit_exponent(shares, target_entropy=1.0)
    assert mixing.entropy(mixing.temperature_weights(shares, h)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.fit_exponent(shares) == 0.0 and mixing.fit_exponent({"x": 1.0}, repeats=1.5) == 0.0
    assert mixing.fit_exponent(shares, target_entropy=0.0) == pytest.approx(1.0)
    weights = mixing.temperature_weights(shares, 0.5)
    root = math.sqrt(0.7) + math.sqrt(0.2) + math.sqrt(0.1)
    assert weights["a"] == pytest.approx(math.sqrt(0.7) / root) and weights["d"] == 0


def rows_of():
    rows = [(i, ("w " * (1 + i % 7)).strip(), "big", 1) for i in range(300)]
    rows += [(1000 + i, f"x{i} y z", "small", 1) for i in range(40)] + [(2000, None, None, 1), (2001, "", "tiny", 1), (None, "no id", "tiny", 1), (2002, "twin", "tiny", 1), (2002, "twin", "tiny", 1)]
    return rows


def tokens(text):
    return max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))


@pytest.mark.parametrize(("budget", "repeats"), [(None, 3.0), (500, 3.0), (2500, None)])
def test_budgets_are_met(spark, monkeypatch, budget, repeats):
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass int")
    got = mixing.mix_sources(spark, docs, repeats=repeats, budget=budget)
    assert got.columns == ["doc_id", "text", "source", "mix_tokens", "mix_pass", "mix_block", "mix_weight"]
    sums, largest = defaultdict(int), defaultdict(int)
    for _, t, s, _ in rows:
        sums[s] += tokens(t)
        largest[s] = max(largest[s], 2 * tokens(t))
    shares = {s: n / sum(sums.values()) for s, n in sums.items()}
    weights = mixing.temperature_weights(shares, mixing.fit_exponent(shares, None, repeats))
    draw = budget or max(sums[s] / w for s, w in weights.items())
    drawn, times = defaultdict(int), defaultdict(int)
    for r in got.collect():
        assert r.mix_tokens == tokens(r.text) and r.mix_weight == pytest.approx(weights[r.source])
        drawn[r.source] += r.mix_tokens
        times[r.source, r.doc_id, r.text] += 1
    for s, w in weights.items():
        assert draw * w - largest[s] - 1 <= drawn[s] <= draw * w + 1e-6, s
        passes = math.floor(draw * w / sums[s] + 1e-9)
        for (d, t, src), n in {(d, t, src): sum(1 for x in rows if x[:3] == (d, t, src)) for d, t, src, _ in rows if src == s}.items():
            assert passes * n <= times[s, d, t] <= (passes + 1) * n
    again = mixing.mix_sources(spark, docs.repartition(3), repeats=repeats, budget=budget)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(spark, docs).collect() == []


def test_other_columns_may_have_any_name(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    names = ["_times", "_key", "_source", "_id", "_hash", "_block", "row", "_tokens", "mix_block"]
    docs = spark.createDataFrame([(*r[:3], *names) for r in rows_of()], ["doc_id", "text", "source", *names])
    got = mixing.mix_sources(spark, docs, repeats=2.0)
    assert got.columns == ["doc_id", "text", "source", *names[:-1], "mix_tokens", "mix_pass", "mix_block", "mix_weight"]
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in rows_of()}
    assert {tuple(r[c] for c in names[:-1]) for r in rows} == {tuple(names[:-1])}
