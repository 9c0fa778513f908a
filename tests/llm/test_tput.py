"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tallyforge.llm import queries
from tallyforge.llm.tput import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 3, 20, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 30)))) for i in range(25)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, run int, term string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, q int").repartition(2)
    want = sorted(brute(docs, items))
    for run_bytes, pass_terms in ((500, 100), (8 << 20, 200_000)):
        got = search(d, q, run_bytes=run_bytes, pass_terms=pass_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- ..."), (None, "alpha beta"), (4, "Alpha BETA"), (4, "alpha beta"), (5, "ÉTÉ été éTé 中文 a_b"), (6, "alpha " * 50_000 + "gamma"), (7, "x" * 100_000)]
    items = [(1, "Alpha gamma"), (1, "Alpha gamma"), (2, None), (3, ""), (None, "beta Été"), (4, "nothing here"), (5, "a"), (6, "中文 中文 b"), (7, "x" * 100_000)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=key)
    assert sorted(map(tuple, search(d, q).collect()), key=key) == want
    assert search(d.limit(0), q).collect() == [] and search(d, q.limit(0)).collect() == [] and search(d.filter("doc_id < 4"), q).collect() == []


def test_table(spark):
    at = "/root/testdata/sf0.001"
    docs, items = ([tuple(r)[:2] for r in spark.read.parquet(f"{at}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    assert sorted(map(tuple, queries.QUERIES["op13_tput_search"](spark, at).collect())) == sorted(brute(docs, items))
