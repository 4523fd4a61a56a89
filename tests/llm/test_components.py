import random

import pytest

from codescope.llm import components as module


def brute(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in up)


def graph(seed):
    rng = random.Random(seed)
    stars = [(rng.randrange(40), 100 + k) for k in range(400)]
    chain = list(zip(range(1000, 1300), range(1001, 1301)))
    edges = stars + chain + [(5000, 5000), (7, 7), (120, 1200)]
    return edges + rng.sample(edges, 50)


@pytest.mark.parametrize("nodes", [1 << 18, 16])
def test_components_equal_brute_force(spark, nodes, monkeypatch):
    monkeypatch.setattr(module, "NODES", nodes)
    edges = graph(1)
    given = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(5)
    assert sorted(map(tuple, module.components(spark, given).collect())) == brute(edges)
    assert module.components(spark, given.limit(0)).collect() == []


def test_small_graph_takes_few_tables(spark, monkeypatch):
    """Each written table costs the driver plans and memory, however small: the edges of one task are done without a round."""
    written = []
    monkeypatch.setattr(module, "write_through", lambda s, df, purpose, f=module.write_through: written.append(purpose) or f(s, df, purpose))
    edges = graph(2)
    found = module.components(spark, spark.createDataFrame(edges, "a long, b long").coalesce(1))
    assert sorted(map(tuple, found.collect())) == brute(edges)
    assert len(written) <= 4  # one round at most
