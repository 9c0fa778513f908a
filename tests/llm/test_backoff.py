"""Stupid backoff against brute force."""

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from tallyforge.llm import backoff


def brute(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    grams = [Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)) for w in words]
    total = sum(grams, Counter())
    every = sum(map(len, words))
    out = []
    for (doc, _), w, own in zip(rows, words, grams, strict=True):
        c = lambda *g: total[g] - own[g]  # noqa: E731, B023
        used, s = [0] * 4, 0.0
        for i, x in enumerate(w):
            if i > 1 and c(w[i - 2], w[i - 1], x):
                k, v = 3, c(w[i - 2], w[i - 1], x) / c(w[i - 2], w[i - 1])
            elif i > 0 and c(w[i - 1], x):
                k, v = 2, c(w[i - 1], x) / c(w[i - 1])
            else:
                k, v = 1, max(c(x), 0.5) / max(every - len(w), 1)
            used[k] += 1
            s += math.log(v) + (min(i, 2) + 1 - k) * math.log(0.4)
        out.append((doc, len(w), used[3], used[2], used[1], s))
    return out


def test_scores(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(40)] + ["É", "The", "the"]
    rows = [(i, " ".join(r.choice(words[: r.randint(3, 43)]) for _ in range(r.randint(0, 50)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "only here"), (103, "w1 " * 20_000), (rows[0][0], rows[0][1]), (None, "w1 w2 w3")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, batch int")
    key = lambda x: (-1 if x[0] is None else x[0], x[1:])
    for got, want in zip(sorted(map(tuple, backoff.backoff_scores(df).collect()), key=key), sorted(brute(rows), key=key), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], abs=1e-6)
    assert backoff.backoff_scores(df.limit(0)).collect() == []
    assert [tuple(x) for x in backoff.backoff_scores(df.filter("doc_id = 102")).collect()][0][1] == 2


def test_a_run_holds_few_arrays():
    r = random.Random(3)
    words = [[f"w{r.randrange(3000)}" for _ in range(1000)] for _ in range(600)]
    deflate = zstandard.ZstdCompressor(3).compress
    rows = [(i, deflate(" ".join(w).encode()), i, 0) for i, w in enumerate(words)]
    names = {"doc_id": pa.int64(), "body": pa.binary(), "row": pa.int64(), "batch": pa.int32()}
    run = backoff._table(names, rows)
    asked = backoff._ask_short(run, 4)
    n = [backoff.pack(3 * backoff.unpack(x)) for x in asked.column("n").to_pylist()]
    said = backoff._table(backoff.SAY, list(zip([0] * 4, asked.column("slice").to_pylist(), n, [10**6] * 4, strict=True)))
    tracemalloc.start()
    try:
        backoff._ask_long(run, said, 4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 * 600_000  # bytes a word
