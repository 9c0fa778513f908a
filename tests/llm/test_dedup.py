"""Exact and SimHash dedup against brute force."""

import hashlib
import random
import tempfile
from collections import defaultdict

import numpy as np
import xxhash

from tallyforge.llm import exact, simhash

SCHEMA = "doc_id long, text string, rep string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def mixed(n=120, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = r.choice(texts)
        if r.random() < 0.3:
            t = t.upper()
        if r.random() < 0.2:
            t += " tail"
        rows.append((i, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "É é"), (n + 4, "é é"), (n + 5, "word " * 30_000), (n + 6, "one")]


def low(t):
    return (t or "").encode().lower()


def test_exact(spark):
    rows = mixed()
    rows.append((7, rows[7][1]))  # a repeated row
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact.exact_dedup(docs(spark, rows)).collect())) == want
    assert sorted(map(tuple, exact.exact_dedup(docs(spark, rows), table_bytes=2000).collect())) == want


def test_exact_edges(spark):
    assert exact.exact_dedup(docs(spark, [(1, "a")]).limit(0)).collect() == []
    got = {r.doc_id: r for r in exact.exact_dedup(docs(spark, [(None, "a"), (3, "A"), (None, "b")])).filter("keep_id is not null").collect()}
    assert got[None].keep_id == 3 and got[3].group_size == 2 and not got[None].kept


def test_grace_recursion():
    rows = [(i, xxhash.xxh64_intdigest(str(i % 50)), str(i % 50).encode() * 20, i, 1) for i in range(500)]
    with tempfile.TemporaryDirectory() as d:
        got = {r: (k, n) for r, k, n in exact._grace(iter(rows), 0, 400, d)}
    assert got == {i: (450 + i % 50, 10) for i in range(500)}


def fingerprint(t, width=4):
    words = low(t).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(f, most):
    root = list(range(len(f)))
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= most:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_near(spark):
    rows = [r for r in mixed(90) if len(r[1] or "") < 10_000]
    f = [fingerprint(t) for _, t in rows]
    root = closure(f, 4)
    want = sorted((i, f"{x:016x}", rows[k][0]) for (i, _), x, k in zip(rows, f, root, strict=True))
    assert sorted(map(tuple, simhash.near_dedup(docs(spark, rows)).collect())) == want
    assert simhash.near_dedup(docs(spark, rows).limit(0)).collect() == []


def test_near_odd_rows(spark):
    """Null and repeated ids, repeated rows, a very long text, columns named like the operator's own."""
    long = " ".join(str(i % 9973) for i in range(50_000))
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "A B c d e f g"), (4, "x y"), (9, None), (9, None), (2, " "), (7, long), (8, long), (None, "only here one two")]
    df = spark.createDataFrame([(i, t, "f", 5, 6) for i, t in rows], "doc_id long, text string, fp string, least int, component_id int")
    f = [fingerprint(t) for _, t in rows]
    root = closure(f, 4)
    least = {}
    for (i, _), k in zip(rows, root, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    want = [(i, f"{x:016x}", least[k]) for (i, _), x, k in zip(rows, f, root, strict=True)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, simhash.near_dedup(df).collect()), key=key) == sorted(want, key=key)


def test_very_long_fingerprint():
    t = " ".join(str(i % 977) for i in range(5000))
    assert int(simhash.fingerprints([b"", simhash.shingle_hashes(t.encode(), 4)])[1]) == fingerprint(t)


def test_large_buckets(monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 16)
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(6)]
    f = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(60)})
    got = simhash.bucket_components(np.array(f, np.uint64), 4)
    assert got.tolist() == closure(f, 4)


def test_masks_cover_all_close_pairs():
    r = random.Random(5)
    for n in (10, 10**6, 10**9):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            d = sum(1 << b for b in r.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)
