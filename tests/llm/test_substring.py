"""Passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tallyforge.llm import substring as S


def brute(rows, k):
    big = 1 << 70
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = defaultdict(lambda: big)
    ids = [big - 1 if i is None else i for i, _ in rows]
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - k + 1):
            first[tuple(w[s : s + k])] = min(first[tuple(w[s : s + k])], i)
    out = []
    for (doc, _), i, w in zip(rows, ids, words, strict=True):
        gone = {s + j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < i for j in range(k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_paths(rows, k):
    """(first row, words) of each nonbranching path of repeated edges, rows numbered in order."""
    big = 1 << 70
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    ids = [big if i is None else i for i, _ in rows]
    where = defaultdict(list)
    for r, w in enumerate(words):
        for s in range(len(w) - k + 1):
            where[tuple(w[s : s + k])].append((ids[r], r, s))
    source = {e: min(at) for e, at in where.items() if len({i for i, _, _ in at}) > 1}
    enters, leaves = defaultdict(list), defaultdict(list)
    for e in source:
        leaves[e[:-1]].append(e)
        enters[e[1:]].append(e)
    plain = lambda n: len(enters[n]) == len(leaves[n]) == 1
    root = {e: e for e in source}

    def find(e):
        while root[e] != e:
            e = root[e]
        return e

    for n in list(enters):
        if plain(n):
            root[find(enters[n][0])] = find(leaves[n][0])
    paths = defaultdict(list)
    for e in source:
        paths[find(e)].append(source[e])
    out = defaultdict(list)
    for at in paths.values():
        out[min(r for _, r, _ in at)].append(len(at) + k - 1)
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(12, 40))) for _ in range(6)]
    rows = []
    for i in r.sample(range(1000), n):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 3)):
            cut = r.choice(passages).split()
            a = r.randint(0, 5)
            t += "\n" + " ".join(cut[a : len(cut) - r.randint(0, 5)]) + "  " + " ".join(r.choice(words) for _ in range(r.randint(0, 20)))
        rows.append((i, t))
    rows += [(2000 + j, rows[j][1]) for j in range(5)]
    return rows


def test_brute_force(spark):
    rows = corpus(1)
    rows += [(3000, None), (3001, ""), (3002, "the end " * 20_000), (3003, "the end " * 30), (3004, "one two"), (rows[3][0], rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (3005, "a b " * 12 + "c"), (3006, "a b " * 12), (-5, rows[7][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = [r[:4] for r in map(tuple, S.substring_dedup(df).collect())]
    assert sorted(got, key=key) == sorted(brute(rows, 13), key=key)
    assert S.substring_dedup(df.limit(0)).collect() == []


def test_text_and_paths(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"head {passage} tail"), (2, f"other\n{passage}\n\tend"), (3, passage)]
    got = {r.doc_id: r for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert [got[i].kept_text for i in (1, 2, 3)] == [rows[0][1], "other\nend", ""]


def test_verification():
    table = pa.table({"doc_id": pa.array([7, 1]), "body": pa.array(map(zstandard.compress, [b"a b c d", b"x y"]), pa.binary()), "row": pa.array([1, 0]), "batch": pa.array([0, 0], pa.int32())})
    chunk = {"batch": 0, "src_at": 3, "n": 2, "digest": S.xxhash.xxh3_128_digest(b"b c")}  # the row numbered 0 comes first
    assert S.verified(table, pa.Table.from_pylist([chunk])).num_rows == 0
    with pytest.raises(ValueError):
        S.verified(table, pa.Table.from_pylist([chunk | {"src_at": 2}]))
    assert S._chunks(5, 70) == [(5, 32), (32, 64), (64, 70)] and S._chunks(64, 65) == [(64, 65)]


def test_many_runs(spark, monkeypatch):
    """Runs of a few documents, copies of one document in all of them."""
    monkeypatch.setattr(S, "RUN_BYTES", 2000)
    monkeypatch.setattr(S, "SLICE_BYTES", 1000)
    rows = corpus(5)
    rows += [(4000 + j, rows[0][1] + f" w{j}") for j in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r[:4] for r in map(tuple, S.substring_dedup(df).collect())) == sorted(brute(rows, 13))


@pytest.mark.parametrize("seed", [7, 8])
def test_paths(spark, monkeypatch, seed):
    """Compacted paths, over runs of a few documents, against paths followed edge by edge."""
    monkeypatch.setattr(S, "RUN_BYTES", 3000)
    monkeypatch.setattr(S, "SLICE_BYTES", 1000)
    r = random.Random(seed)
    rows = corpus(seed)
    turns = [" ".join(f"q{r.randint(0, 2)}" for _ in range(30)) for _ in range(3)]  # many branches
    rows += [(5000 + j, f"a{j % 3} " + r.choice(turns) + f" b{j % 2} " + r.choice(turns)) for j in range(12)]
    rows += [(6000 + j, "x y z " * 9) for j in range(2)]  # a path that closes on itself
    rows.sort()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_paths(rows, 13)
    got = {x.doc_id: (x.n_paths, x.longest_path) for x in S.substring_dedup(df).collect()}
    assert sum(map(len, want.values())) == sum(n for n, _ in got.values())
    assert got == {i: (len(want[n]), max(want[n], default=0)) for n, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packing(n):
    v = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert (S.unpack(S.pack(v, True), True) == v).all() and (S.unpack(S.pack(v)) == v).all()
