"""Components against union-find."""

import random

from tessera.llm.components import components, forest


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7), (None, 3), (500, 501), (500, 501), (501, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    import numpy as np

    assert forest(6, (np.array([4, 2, 5]), np.array([2, 1, 3]))).tolist() == [0, 1, 1, 3, 1, 3]
