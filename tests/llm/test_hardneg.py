"""Hard negatives against all pairs."""

import math
import random


import pytest

from tallyforge.llm import hardneg, queries
from tallyforge.llm.hardneg import mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, pivot string, dist int"


def brute(rows, every, k=5):
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda i: (i is None, i or 0)
    out = []
    for at, (a, q, c) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v, strict=False)), place(i), d == c) for j, (i, v, d) in enumerate(rows) if j != at))
        for p, i, _ in [x for x in scored if x[2]][:k]:
            fits = [x for x in scored if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(a, None if i[0] else i[1], n, None if y[0] else y[1], -p, -s) for n, (s, y, _) in enumerate(fits[:k], 1)]
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize(("width", "size"), [(3, 1.0), (8, 40.0), (2, 3000.0)])
def test_random(spark, width, size, monkeypatch):
    r = random.Random(width)
    monkeypatch.setattr(hardneg, "SAMPLE", 40)
    monkeypatch.setattr(hardneg, "PIVOTS", 5)
    rows = [(i, [r.uniform(-size, size) for _ in range(width)], r.randrange(3)) for i in range(300)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], SCHEMA).repartition(3)
    rows = [tuple(x)[:3] for x in df.collect()]
    want = sorted(brute(rows, 10))
    assert len(want) > 100
    for anchors in (7, 8192):
        got = mine_negatives(df, anchor_every=10, anchors=anchors)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25]
    rows = [(0, v, 1), (0, v, 1), (0, v, 2), (100, v, None), (200, None, 1), (300, [nan, 1.0], 1), (400, [None, 1.0], 1), (500, [inf, 1.0], 1), (None, v, 1), (None, v, 3),
            (7, [0.5], 2), (8, [], 2), (9, [0.5, 0.25, 9.0], 2), (-100, [0.4, 0.2], 3), (600, [-0.5, 0.0], 5), (11, [-0.5, 0.01], 5), (700, [], 4), (12, [], 4), (13, v, 1)]
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], SCHEMA)
    want = sorted(brute([tuple(x)[:3] for x in df.collect()], 100), key=key)
    assert sorted(map(tuple, mine_negatives(df).collect()), key=key) == want and want
    assert mine_negatives(df.limit(0)).collect() == []
    assert mine_negatives(df.filter("vec_id = 8")).collect() == []
    assert mine_negatives(df.filter("vec_id IN (700, 12)")).collect() == []
    with pytest.raises(ArithmeticError):
        mine_negatives(spark.createDataFrame([(0, [1e9], 1), (1, [1e9], 1)], "vec_id long, embedding array<float>, label int"))


def test_table(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    want = sorted(brute(rows, 100))
    assert sorted(map(tuple, queries.QUERIES["op12_hard_negatives"](spark, at).collect())) == want and want
