"""Sweeps over intervals against all pairs, with partitions that cut them."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import intervals as I


def made(seed):
    r = random.Random(seed)
    rows = [(p, f"{p}{i}", s, s + r.choice([0, 1, 5, 30, 200])) for p in "xyz" for i in range(r.choice([1, 120])) for s in [r.randrange(300)]]
    points = [(p, r.randrange(330)) for p in "xyw" for _ in range(100)]
    spans = [(p, s, s + r.choice([0, 3, 50]), f"s{i}") for i in range(60) for p, s in [(r.choice("xyw"), r.randrange(320))]]
    return rows, points, spans


@pytest.mark.parametrize(("seed", "size"), [(1, 200_000), (2, 40), (3, 9)])
def test_random(spark, monkeypatch, seed, size):
    monkeypatch.setattr(I, "AT_ONCE", size)
    rows, points, spans = made(seed)
    s = spark.createDataFrame(rows, "path string, symbol_id string, start_byte int, end_byte int").repartition(3)
    want = {}
    for p, at in points:
        around = [(a, i) for q, i, a, b in rows if p == q and a <= at < b]
        if around:
            want[p, at] = max(around)[1]
    got = [tuple(x) for x in I.innermost(s, spark.createDataFrame(points, "path string, offset int")).collect()]
    assert {(p, at): i for p, at, i in got} == want and len(got) == len(want)
    want = {}
    for p, i, a, b in rows:
        around = [(c, -d, j) for q, j, c, d in rows if p == q and c <= a and b <= d and (c < a or b < d)]
        if around:
            want[i] = max(around)[2]
    got = [tuple(x) for x in I.parents(s).collect()]
    assert dict(got) == want and len(got) == len(want)
    lines = s.select("path", "symbol_id", F.col("start_byte").alias("start_line"), F.col("end_byte").alias("end_line"))
    want = sorted((p, i, a, b, lo, hi, k) for p, i, a, b in rows for q, lo, hi, k in spans if p == q and a <= hi and b >= lo)
    got = I.overlaps(lines, spark.createDataFrame(spans, "path string, lo int, hi int, span string"))
    assert got.columns == ["path", "symbol_id", "start_line", "end_line", "lo", "hi", "span"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_one_long_file(spark):
    """A million symbols, two deep, and a million offsets in one file."""
    n = 1_000_000
    i = F.col("id")
    outer = spark.range(n // 100).select(F.lit("f").alias("path"), (-i - 1).alias("symbol_id"), (i * 1000).alias("start_byte"), (i * 1000 + 1000).alias("end_byte"))
    inner = spark.range(n).select(F.lit("f").alias("path"), i.alias("symbol_id"), (i * 10 + 2).alias("start_byte"), (i * 10 + 8).alias("end_byte"))
    points = spark.range(n).select(F.lit("f").alias("path"), (i * 10 + F.when(i % 2 == 0, 5).otherwise(9)).alias("offset"))
    got = I.innermost(outer.unionByName(inner), points).select(F.count(F.lit(1)), F.sum("symbol_id"), F.count_if(F.expr("symbol_id < 0"))).first()
    assert tuple(got) == (n, sum(range(0, n, 2)) - sum(k // 100 + 1 for k in range(1, n, 2)), n // 2)
    up = I.parents(outer.unionByName(inner)).select(F.count(F.lit(1)), F.count_if(F.expr("parent_id = -(symbol_id div 100) - 1"))).first()
    assert tuple(up) == (n, n)


def test_empty(spark):
    s = spark.createDataFrame([], "path string, symbol_id long, start_byte int, end_byte int")
    assert I.innermost(s, spark.createDataFrame([("f", 1)], "path string, offset int")).collect() == [] and I.parents(s).collect() == []
