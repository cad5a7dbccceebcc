"""Embedding near-dedup against all pairs, with hot groups, copies and unsound vectors."""

import math

import numpy as np
import pytest

from tessera.llm.embedding_dedup import near_duplicates

VEC = "vec_id long, embedding array<float>, rep string, keys int"


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    vs = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, v), g in zip(rows, ok)]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


@pytest.mark.parametrize("block", [2048, 7])
def test_matches_all_pairs(spark, block):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(25):
        c = rng.standard_normal(64)
        for _ in range(int(rng.choice([1, 1, 2, 5, 40]))):
            rows.append((c + rng.standard_normal(64) * 0.1).tolist())
    rows += [rows[0]] * 5 + [None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0] * 3, [1.0] * 3, [2.0, 2.0, 2.0], []]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    got = near_duplicates(spark.createDataFrame([(i, v, "", 0) for i, v in rows], VEC), block=block).collect()
    want = brute(rows)
    found, all_ = sum(r["n_links"] for r in got), sum(w[1] for w in want)
    assert 0.99 * all_ <= found <= all_
    assert sorted((r["vec_id"], r["component_id"], r["kept"]) for r in got) == [(w[0], w[2], w[3]) for w in want]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(3, None, "", 0)], VEC)).collect()] == [(3, 0, 3, True)]


def test_recall_with_a_common_mean(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = rng.standard_normal((1500, 64))
    x[:, 0] += 16
    x = unit(x)
    off = rng.standard_normal(x.shape)
    off = unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    both = np.concatenate([x, 0.951 * x + math.sqrt(1 - 0.951**2) * off])
    assert np.linalg.norm(both.mean(axis=0)) > 0.85
    rows = [(i, v.tolist(), "", 0) for i, v in enumerate(both)]
    got = near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    exact = unit(both.astype(np.float32).astype(float))
    want = int((exact @ exact.T >= 0.95).sum()) - len(both)
    assert 0.97 * want <= sum(r["n_links"] for r in got) <= want


def test_one_id_for_two_vectors(spark):
    """Vector 1 is at A and at B, vector 2 near A, vector 3 near B and vector 4 near nothing."""
    rng = np.random.default_rng(1)
    a, b, c = rng.standard_normal((3, 64))
    rows = [(1, a), (1, b), (2, a + 1e-3), (3, b + 1e-3), (4, c), (None, a)]
    got = near_duplicates(spark.createDataFrame([(i, v.tolist(), "", 0) for i, v in rows], VEC)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
    alone = near_duplicates(spark.createDataFrame([(i, v.tolist(), "", 0) for i, v in rows[:3]], VEC)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in alone) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_recall_on_the_test_table(spark):
    """Recall of links against brute force: all vectors of sf0.1, of which no two are near, and a copy of each turned by up to the threshold's angle."""
    rng = np.random.default_rng(4)
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [r for r in got if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v = unit(np.array([r["embedding"] for r in rows], float))
    off = rng.standard_normal(v.shape)
    off = unit(off - (off * v).sum(axis=1, keepdims=True) * v)
    c = rng.uniform(0.94, 1, (len(v), 1))
    both = np.concatenate([v, c * v + np.sqrt(1 - c**2) * off]).astype(np.float32)
    found = near_duplicates(spark.createDataFrame([(i, x.tolist(), "", 0) for i, x in enumerate(both)], VEC)).agg({"n_links": "sum"}).collect()[0][0]
    exact = unit(both.astype(float))
    want = sum(int((exact[at : at + 1000] @ exact.T >= 0.95).sum()) for at in range(0, len(exact), 1000)) - len(exact)
    assert want > len(v) and 0.98 * want <= found <= want, found / want
