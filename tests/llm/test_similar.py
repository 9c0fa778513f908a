"""Near copies by Jaccard similarity, and the pipeline's stage, against brute force."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers  # noqa: F401
from test_dedup import low

from tallyforge.llm import similar


def shingles(t, width=5):
    w = low(t).split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def roots(texts, least=0.8):
    s = [shingles(t) for t in texts]
    root = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] == s[j] or len(s[i] & s[j]) / len(s[i] | s[j]) >= least:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def family(r, n, words, edits):
    """A text and copies of it with up to `edits` words replaced."""
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in r.sample(range(words), r.randint(0, edits)):
            t[at] = f"x{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_similar(spark):
    r = random.Random(4)
    texts = [t for words, edits in ((60, 3), (80, 3), (120, 5), (300, 12), (600, 25), (50, 2)) for t in family(r, 12, words, edits)]
    texts += family(r, 60, 100, 4) + ["one", "ONE", "a b", None, "", " \n"]
    want = [(i, k) for i, k in enumerate(roots(texts))]
    assert 20 < len({k for _, k in want}) < len(texts) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, similar.similar_dedup(docs).collect())) == want
    assert similar.similar_dedup(docs.limit(0)).collect() == []


def test_the_last_round_pairs_all_that_are_apart(spark):
    """Chains: each text is similar to the one before and after it alone, so no single leader of a bucket links them."""
    r = random.Random(6)
    texts = []
    for _ in range(6):
        w = [f"w{r.randrange(10**6)}" for _ in range(130)]
        texts += [" ".join(w[k * 10 : k * 10 + 100]) for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, similar.similar_dedup(docs).collect())) == list(enumerate(roots(texts)))


def test_stage(spark):
    """The stage that the pipeline runs drops a copy of similarity 0.8 that is over 4 bits away."""
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(tuple(x) for x in docs.collect())
    want = [x for i, (x, k) in enumerate(zip(rows, roots([x[1] for x in rows]), strict=True)) if i == k]
    assert sorted(tuple(x) for x in stage(spark, docs, "").collect()) == want and 177 not in {x[0] for x in want}


def test_recall(spark):
    """A thousand and more planted pairs of similarity 0.8 to 0.85: all are found, and no two texts that aren't linked are joined."""
    r = random.Random(11)
    texts = []
    for _ in range(1200):
        base = [f"w{r.randrange(10**7)}" for _ in range(r.randint(140, 210))]
        copy = list(base)
        for at in range(20, 20 + 30 * (len(base) // 50), 30):
            copy[at] = f"x{r.randrange(10**7)}"
        texts += [" ".join(base), " ".join(copy)]
    s = [shingles(t) for t in texts]
    near = [len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in range(0, len(s), 2)]
    assert sum(0.8 <= x <= 0.86 for x in near) > 1000
    got = {x.doc_id: x.component_id for x in similar.similar_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, x in enumerate(near):
        assert got[2 * k] == 2 * k and got[2 * k + 1] == (2 * k if x >= 0.8 else 2 * k + 1)


def test_unlike_copies_are_not_paired(spark):
    """Many copies of one text, too far from each other to be linked, beside texts that share nothing: all links come out, few other pairs."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**7)}" for _ in range(160)]
    texts = [" ".join(f"x{r.randrange(10**7)}" if at in where else w for at, w in enumerate(base)) for where in (set(r.sample(range(160), 3)) for _ in range(150))]
    texts += [f"{t} and" for t in texts[:20]] + [" ".join(f"v{r.randrange(10**7)}" for _ in range(1200)) for _ in range(150)]
    sets = [similar.shingle_set(t.encode(), 5) for t in texts]
    nodes = [similar.node_of(s) for s in sets]
    held = spark.createDataFrame([(n, len(s), n) for n, s in zip(nodes, sets, strict=True)], "node long, size int, root long")
    hashes = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(nodes, sets, strict=True)], "node long, hashes binary")
    got = {tuple(x) for x in similar._prefix_pairs(held, hashes, 0.8).collect()}
    want = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                want.add((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    assert want <= got and 20 <= len(want) and len(got) <= len(want) + 1000


def test_fingerprint_blocks(spark, monkeypatch):
    """Pairs of similarity 0.8 and more meet by a block of their fingerprints, verified by Hamming distance, in small and in large
    buckets; unlike sets don't."""
    r = np.random.default_rng(13)
    plan, sets = similar.block_plan(200_000), []
    for n in (9, 18, 45, 90, 450):
        for _ in range(60):
            a = r.integers(0, 2**64, n, np.uint64)
            sets += [a, np.r_[a[: n * 8 // 9], r.integers(0, 2**64, n - n * 8 // 9, np.uint64)]]
    base = r.integers(0, 2**64, 300, np.uint64)
    sets += [np.r_[base[20:], r.integers(0, 2**64, 20, np.uint64)] for _ in range(100)]
    made = [similar.wide_fingerprint(s, plan[0] * plan[1]) for s in sets]
    rows = [(i, len(sets[i]), *(int(x) for x in np.packbits(f[:128]).view(np.int64)), similar.block_keys(f, *plan).tolist()) for i, f in enumerate(made)]
    nodes = spark.createDataFrame(rows, "node long, size int, first long, second long, keys array<int>")
    stars = {}
    for x in similar.near_stars(nodes).collect():
        stars.setdefault(x.key, set()).add(x.node)
    met = {(min(s), i) for s in stars.values() for i in s}
    assert all((i, i + 1) in met for i in range(0, 600, 2)) and len({i for _, i in met if i >= 600}) == 100
    assert sum(i < 600 <= j or i + (i % 2 == 0) < j < 600 for i, j in met) <= 5
    f = np.array([x[2:4] for x in rows]).view(np.uint64)
    near = lambda i: np.bitwise_count(f ^ f[i]).sum(1) <= similar.RADIUS
    for most in (2048, 16):
        monkeypatch.setattr(similar, "BRUTE", most)
        label = similar.near_labels(np.zeros(len(f), np.int32), f)
        assert all((label[near(i)] == label[i]).all() for i in range(len(f))) and len(set(label[:600].tolist())) >= (290 if most > 700 else 1)
    assert similar.near_stars(nodes.limit(0)).collect() == []
