"""Nearest neighbours in blocks, against brute force."""

import random

import numpy as np

from tallyforge.operators import memory as M


def test_more_queries_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERY_LIMIT", 16)
    r = random.Random(2)
    rows = [(i, "c", [float(r.randint(0, 9)) for _ in range(4)]) for i in range(60)]
    want = []
    for i, _, q in rows[:50]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), j) for j, _, v in rows if j != i)
        want += [(i, j, d, k) for k, (d, j) in enumerate(near[:3], 1)]
    v = spark.createDataFrame(rows, "key long, category string, vector array<double>")
    got = M.knn(v.filter("key < 50"), v, 3).select("key", "neighbour", "d2", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cells_copies_and_odd_vectors(spark, monkeypatch):
    """Blocks of both sides, a large group of copies, vectors that have no distance; no pair of rows is made that isn't near."""
    for name, n in (("BASE_LIMIT", 64), ("QUERY_LIMIT", 16), ("LEAST_BASE", 8)):
        monkeypatch.setattr(M, name, n)
    r = random.Random(5)
    rows = [(i, f"c{i % 3}", [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows[100:200] = [(i, f"c{i % 3}", rows[100][2]) for i in range(100, 200)]
    rows += [(300, "c", None), (301, "c", [1.0] * 7), (302, "c", [None] * 8)]
    v = spark.createDataFrame(rows, "key long, category string, vector array<float>")
    none = {300, 301, 302}
    at = {i: np.array(x, np.float32) for i, _, x in rows if i not in none}

    def d2(i, j):
        return sum(((at[i] - at[j]) * (at[i] - at[j])).astype(np.float64).tolist())

    want = []
    for i, c, _ in rows[::4]:
        others = [j for j, _, _ in rows if j != i]
        near = sorted((i in none or j in none, 0.0 if i in none or j in none else d2(i, j), j) for j in others)[:12]
        want += [(i, c, j, rows[j][1], None if null else d, k) for k, (null, d, j) in enumerate(near, 1)]
    got = M.knn(v.filter("key % 4 = 0 OR key > 299").filter("key % 4 = 0"), v, 12)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    few = M.knn(v.filter("key = 1"), v.filter("key IN (1, 2, 300)"), 5).orderBy("rank").collect()
    assert [(x.neighbour, x.d2 is None) for x in few] == [(2, False), (300, True)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert M.knn(v.limit(0), v, 5).collect() == [] and M.knn(v, v.limit(0), 5).collect() == []
