"""Quality rules: base statistics against brute force, the verdict against a numpy version."""

import collections
import math
import random
import re

import numpy as np

from tallyforge.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, kept string, x0 string"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines)


def rows(seed=2):
    r = random.Random(seed)
    out = []
    for i in range(300):
        n = r.randint(60, 400)
        t = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", ".\n"]) for _ in range(n))
        out.append([i, t, r.choice(["en", "de", None]), r.choice(["s", "s", "t"]), "k", "x"])
    for i in range(300, 312):
        out.append([i, " ".join("z#%" + "".join(r.choice("abcdefghijk") for _ in range(9)) for _ in range(200)), "en", "s", "k", "x"])
    odd = [None, "", " \n\t ", "a b c a b c", "x y z\nx y z\n\n\nx y z", "no no no no no", "word", "lone pair", "é " * 70, "é è\x0b€ \x85x" * 30, "the end " * 40_000]
    return out + [[1000 + i, t, None, "odd", "k", "x"] for i, t in enumerate(odd)] + [out[0]]


def verdicts(data):
    groups = collections.defaultdict(list)
    for i, row in enumerate(data):
        n, chars, sym, dup, rep, lines = brute(row[1])
        if n >= 50 and 100 * rep <= 50 * n:
            f = (math.log(n), math.log(chars / n), math.log1p(sym / n), math.log1p(dup / max(lines, 1)), math.log1p(rep / n))
            groups[row[2], row[3]].append((i, [math.floor(v * Q.STEP + 0.5) for v in f]))
    kept = {}
    for members in groups.values():
        x = np.array([f for _, f in members], float) / Q.STEP
        bins = np.sort(np.array([[v // 16 for v in f] for _, f in members]), axis=0)
        at = lambda p: bins[max(0, math.ceil(p * len(bins)) - 1)] * 16 / Q.STEP  # noqa: E731, B023
        floors = np.array(Q.FLOORS) ** 2
        best = None
        for start in (0, 1):
            mean, cov = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 * (1 - start) + floors)
            least = None
            while True:
                y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
                b = np.floor(np.log1p((y * y).sum(0)) * 512)
                inside = x[b <= np.sort(b)[max(0, math.ceil(Q.SUPPORT * len(b)) - 1)]]
                mean = inside.mean(0)
                cov = ((inside.T @ inside) / len(inside) - np.outer(mean, mean)) * Q.CONSISTENCY + np.diag(floors)
                det = np.linalg.slogdet(cov)[1]
                if least is not None and det >= least[0] - Q.TOLERANCE:
                    break
                least = (det, mean, cov)
            if best is None or least[0] < best[0] - 1e-9:
                best = least
        y = np.linalg.solve(np.linalg.cholesky(best[2]), (x - best[1]).T)
        kept |= {i: d <= Q.CUT for (i, _), d in zip(members, (y * y).sum(0), strict=True)}
    return [bool(kept.get(i, False)) for i in range(len(data))]


def test_quality(spark):
    data = rows()
    want = sorted((r[0], *brute(r[1])[:5], k) for r, k in zip(data, verdicts(data), strict=True))
    got = Q.quality_rules(spark.createDataFrame(data, SCHEMA))
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in got.collect()) == want
    kept = {r[0] for r in want if r[-1]}
    assert kept >= set(range(300)) and not kept & set(range(300, 312))
    assert Q.quality_rules(spark.createDataFrame(data, SCHEMA).limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    data = [[None, *r[1:]] if i % 3 else [7, *r[1:]] for i, r in enumerate(rows(5))]
    got = Q.quality_rules(spark.createDataFrame(data, SCHEMA)).collect()
    want = [(r[0], *brute(r[1])[:5], k) for r, k in zip(data, verdicts(data), strict=True)]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in got), key=key) == sorted(want, key=key)


def test_smallest_determinant(spark):
    """The estimate against the best of many random starts, on made-up clouds with far and with near outliers."""
    g = np.random.default_rng(17)
    for n, share, far in ((120, 0.0, 0), (200, 0.2, 3.0), (300, 0.2, 0.6)):
        a = g.normal(size=(5, 5)) * 0.2
        x = g.normal(size=(n, 5)) @ a + [5.5, 1.6, 0.1, 0.1, 0.1]
        x[: int(n * share)] += far * g.normal(size=5)
        x = np.round(x * Q.STEP)
        df = spark.createDataFrame([("a", "b", *map(int, r)) for r in x], "lang_key string, source_key string, x0 long, x1 long, x2 long, x3 long, x4 long")
        got = Q.fit(df).collect()[0].log_det
        x /= Q.STEP
        h, floors, least = math.ceil(Q.SUPPORT * n), np.diag(np.array(Q.FLOORS) ** 2), math.inf
        for _ in range(300):
            some = x[g.choice(n, 6, replace=False)]
            for _ in range(30):
                mean, cov = some.mean(0), np.cov(some.T, bias=True) * Q.CONSISTENCY + floors
                some = x[np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))[:h]]
            least = min(least, np.linalg.slogdet(np.cov(some.T, bias=True) * Q.CONSISTENCY + floors)[1])
        assert got < least + 0.1


def test_no_python_in_the_plan(spark):
    plan = Q.quality_rules(spark.createDataFrame(rows()[:50], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chi_square():
    assert abs(Q._chi2_quantile(0.75, 5) - 6.6257) < 1e-3 and abs(Q._chi2_cdf(7.815, 3) - 0.95) < 1e-4


def planted(r, n=250, letters=5, symbols=0.0, again=0.0, repeats=0.0):
    """Lines of two words each; a share of words with a symbol, of lines that are copies, of words in repeated windows."""
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(letters))
    lines = [[word(), word()] for _ in range(n // 2)]
    k = round(again * len(lines))
    lines = lines[: len(lines) - k] + [list(x) for x in lines[:k]]
    r.shuffle(lines)
    w = [x for line in lines for x in line]
    if repeats:
        k = round(repeats * n / 2)
        w[k + 1 : 2 * k + 1] = w[:k]  # an odd shift, so that no line is a copy
        w[k] = word()
    w = [x[:-1] + "#" if i < symbols * n else x for i, x in enumerate(w)]
    return "\n".join(f"{a} {b}" for a, b in zip(w[::2], w[1::2], strict=True))


def test_each_statistic_rejects_alone(spark):
    r = random.Random(8)
    texts = [planted(r, 2 * r.randint(50, 200)) for _ in range(100)]
    odd = [dict(n=20_000), dict(letters=10), dict(symbols=0.36), dict(again=0.45), dict(repeats=0.45)]
    texts += [planted(r, **x) for x in odd]
    base = [brute(t) for t in texts[100:]]
    assert all(2 * b[4] <= b[0] for b in base)
    alone = [[b[0] > 1000, b[1] > 8 * b[0], b[2] > 0, b[3] > 0.1 * b[5], b[4] > 0.1 * b[0]] for b in base]
    assert alone == [[i == j for j in range(5)] for i in range(5)]
    got = Q.quality_rules(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    kept = {x.doc_id for x in got.filter("kept").collect()}
    assert kept == set(range(100))
