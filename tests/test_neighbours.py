"""The neighbour index against exact neighbours."""

import numpy as np

from tallyforge.operators import memory as M
from tallyforge.operators import neighbours as V


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, str(i % 5), [float(x) for x in r]) for i, r in enumerate(v)], "key long, category string, vector array<float>")


def test_recall_and_inserts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 150)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 24)) * 3
    v = centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 24))
    v[1000:1400] = v[5]  # a list with a large group of copies
    df = frame(spark, v)
    model = V.fit(df)
    assert model.probes < len(model.centres) / 2
    index = V.build(df.filter("key < 2000"), model, str(tmp_path / "i"))
    asked = df.filter("key % 20 = 0")
    exact = {(x.key, x.neighbour) for x in M.knn(asked, df.filter("key < 2000"), 10).collect() if x.key % 7}
    got = {(x.key, x.neighbour) for x in V.search(asked, index, model, 10).collect() if x.key % 7}
    alike = lambda a: 1000 <= a < 1400 or a == 5
    assert len([p for p in exact if not alike(p[0]) and p not in got]) <= 0.1 * len(exact)
    index = V.insert(df.filter("key >= 2000"), model, str(tmp_path / "i"))
    assert index.count() == 3000 and index.groupBy("list", "block").count().agg({"count": "max"}).first()[0] < 600
    exact = {(x.key, x.neighbour): x.rank for x in M.knn(asked, df, 10).collect() if not alike(x.key)}
    rows = [x for x in V.search(asked, index, model, 10).collect() if not alike(x.key)]
    assert len(set(exact) & {(x.key, x.neighbour) for x in rows}) >= 0.9 * len(exact)
    assert all(x.neighbour_category == str(x.neighbour % 5) and x.key != x.neighbour for x in rows)


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [0.0, 1.0]), (2, None, [0.0, 2.0]), (3, "a", None), (4, "a", [1.0])], "key long, category string, vector array<float>")
    model = V.fit(df.filter("key < 3"))
    index = V.build(df, model, str(tmp_path / "i"))
    assert [(x.key, x.neighbour, x.d2, x.rank) for x in V.search(df, index, model, 3).orderBy("key").collect()] == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    empty = df.limit(0)
    assert V.search(empty, index, model, 3).collect() == [] and V.fit(empty).probes == 1


def test_evenly_spread_vectors_and_copies(spark, tmp_path):
    """Where all are about as far from each other the codes still tell who is near; of more copies than are compared exactly those of
    the smallest keys are found."""
    r = np.random.default_rng(8)
    v = r.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[r.permutation(4000)[:500]] = v[0]
    df = frame(spark, v)
    model = V.fit(df)
    index = V.build(df, model, str(tmp_path / "i"))
    asked = df.filter("key % 20 = 0")
    exact = {(x.key, x.neighbour) for x in M.knn(asked, df, 10).collect()}
    got = {(x.key, x.neighbour) for x in V.search(asked, index, model, 10, again=2).collect()}
    same = {i for i in range(4000) if (v[i] == v[0]).all()}
    assert len(exact & got) >= 0.9 * len(exact)
    assert {p for p in exact if p[0] in same} == {p for p in got if p[0] in same}
