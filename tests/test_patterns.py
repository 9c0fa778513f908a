"""Many literals at once, against the plain search for each."""

import random

import pytest

from tallyforge.operators import evals as E
from tallyforge.operators import graph as G
from tallyforge.operators import patterns as M
from tallyforge.operators import text as T


@pytest.mark.parametrize("shard", [1_000_000, 40])
def test_occurrences(spark, monkeypatch, shard):
    monkeypatch.setattr(M, "SHARD_CHARS", shard)
    r = random.Random(5)
    texts = [(i, "".join(r.choice("ab \n\u00e9") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (None, "ab")]
    words = ["", "a", "ab", "ba", "aab", "\u00e9a", " ", "b\n", "abab", "never", *{"".join(r.choice("ab ") for _ in range(r.randint(3, 8))) for _ in range(60)}]
    t = spark.createDataFrame(texts, "key long, text string").repartition(3)
    p = spark.createDataFrame([(w,) for w in [*words, "a"]] + [(None,)], "pattern string")
    want = {(i, w) for i, x in texts if x is not None for w in words if w in x}
    got = [tuple(x) for x in M.occurrences(t, p).collect()]
    assert len(got) == len(want) and set(got) == want
    lines = {(i, w, n, x) for i, text in texts if text is not None for w in words if "\n" not in w for n, x in [(n, x) for n, x in enumerate((text[:-1] if text.endswith("\n") else text).split("\n"), 1) if w in x][:2]}
    got = [tuple(x) for x in M.line_hits(t, p, 2).collect()]
    assert set(got) == lines and len(got) == len(lines)


def test_no_patterns(spark):
    t = spark.createDataFrame([(1, "x")], "key long, text string")
    none, empty = spark.createDataFrame([], "pattern string"), spark.createDataFrame([("",)], "pattern string")
    assert M.occurrences(t, none).collect() == [] and [tuple(r) for r in M.occurrences(t, empty).collect()] == [(1, "")]
    assert [tuple(r) for r in M.line_hits(t, empty, 3).collect()] == [(1, "", 1, "x")]


def test_passages(spark):
    """Short passages in any number, ones that begin within a word, and null."""
    items = [(i, f"w{i}") for i in range(1500)] + [(2000, "4 w3"), (2001, "not there"), (2002, None), (2003, "")]
    docs = spark.createDataFrame([(5, "xw1400 w31"), (4, "w4 w3"), (9, None)], "doc_id long, text string")
    got = {r.item_id: (r.doc_id, r.hit) for r in E.passages(spark.createDataFrame(items, "item_id long, text string"), docs).collect()}
    assert len(got) == 1504 and got[3] == (4, True) and got[31] == (5, True) and got[1400] == (5, True) and got[140] == (5, True)
    assert got[2000] == (4, True) and got[2001] == (None, False) and got[2002] == (None, False) and got[2003] == (4, True)


def test_imports(spark):
    """Which candidates an import has, by hand."""
    rows = [("a/b/x.ts", "./util"), ("a/b/x.ts", "../c/./y.css"), ("x.ts", "../../z"), ("a/x.py", ".sib"), ("x.py", "...p.q"), ("a/x.py", "."), ("a/x.vue", "@/b/y"), ("a/x.go", "host/repo/tail"), ("a/x.py", "p.q")]
    df = spark.createDataFrame(rows, "path string, module string")
    got = {}
    for r in G.module_candidates(df).orderBy("ordinal").collect():
        got.setdefault((r.path, r.module), []).append(r.candidate)
    ext = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue"]
    script = lambda b, own=False: ([b] if own else []) + [b + e for e in ext] + [f"{b}/index{e}" for e in ext]
    assert got[rows[0]] == script("a/b/util") and got[rows[1]] == script("a/c/y.css", True) and got[rows[2]] == script("../../z")
    assert got[rows[3]] == ["a/sib.py", "a/sib/__init__.py"] and got[rows[4]] == ["p/q.py", "p/q/__init__.py"] and got[rows[5]] == ["a.py", "a/__init__.py"]
    assert got[rows[6]] == script("src/b/y") + script("b/y") and got[rows[7]] == ["host/repo/tail.py", "host/repo/tail/__init__.py", *script("host/repo/tail"), "tail.go"]
    assert got[rows[8]] == ["p/q.py", "p/q/__init__.py", *script("p.q", True), "p.q.go"]
    assert [r.target for r in G.resolve_imports(df, spark.createDataFrame([("tail.go",), ("a/sib/__init__.py",)], "path string")).orderBy("target").collect()] == ["a/sib/__init__.py", "tail.go"]


def test_deep_names(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(99, 77, "lost")]
    got = {r.symbol_id: r.qualified_name for r in G.qualified_names(spark.createDataFrame(rows, "symbol_id long, parent_id long, name string")).collect()}
    assert got[39] == ".".join(f"n{i}" for i in range(40)) and got[0] == "n0" and got[99] == "lost"
    with pytest.raises(ValueError):
        G.qualified_names(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "symbol_id long, parent_id long, name string"))


def test_suffixes_and_rules(spark, monkeypatch):
    monkeypatch.setattr(T, "RULES_AT_ONCE", 2)
    df = spark.createDataFrame([("a/b.MP4", 1), (".png", 1), ("x.png/y", 1), ("lib.tar.gz", 1), ("k1.txt", 1), ("kx.txt", 1), ("sub/keep.log", 0), ("big.py", 524289)], "path string, size long")
    got = {r.path: r.reason for r in df.select("path", T.skip_reason(df["path"], df["size"]).alias("reason")).collect()}
    assert got == {"a/b.MP4": "binary file", ".png": None, "x.png/y": None, "lib.tar.gz": "binary file", "k1.txt": None, "kx.txt": None, "sub/keep.log": "empty file", "big.py": "larger than 512 KB"}
    rules = spark.createDataFrame([(0, "k[0-9].txt", "r0"), (1, "*.log", "r1"), (2, "!sub/keep.log", "r2"), (3, "b[!j]g.py", "r3"), (4, "nothing", "r4")], "ordinal int, pattern string, source string")
    got = {r.path: r.ignored for r in T.ignore_reasons(df, rules).collect() if r.ignored}
    assert got == {"k1.txt": "ignored by rule 'r0'", "big.py": "ignored by rule 'r3'"}


def test_a_task_hands_on_the_first_hits_only(spark, monkeypatch):
    """Long lines that hold many patterns: a task's rows don't grow with its texts, and every first hit is among them."""
    texts = spark.createDataFrame([(i, f"x{i} ab bc cd " * 50 + "\nab") for i in range(400, 0, -1)] + [(None, "cd"), (401, None)], "key long, text string").coalesce(1)
    patterns = spark.createDataFrame([("ab",), ("bc",), ("cd",), ("x7 ",), ("",)], "pattern string")
    rows = M.first_hits(texts, patterns, 3).collect()
    assert len(rows) == 13
    first = lambda found: {p: sorted((x.key is not None, x.key, x.line_no, x.line) for x in found if x.pattern == p)[:3] for p in ("ab", "bc", "cd", "x7 ", "")}
    assert first(rows) == first(M.line_hits(texts, patterns, 3).collect())
    monkeypatch.setattr(M, "HELD_CHARS", 3000)
    assert first(M.first_hits(texts, patterns, 3).collect()) == first(rows)


def test_few_texts_meet_all_shards_in_one_job(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "xabcx"), ("b", "bcd"), ("c", None), ("d", "")], "key string, text string")
    patterns = spark.createDataFrame([("ab",), ("bc",), ("cd",), ("x",), ("",)], "pattern string")
    whole = sorted(map(tuple, M.occurrences(texts, patterns).collect()))
    monkeypatch.setattr(M, "SHARD_CHARS", 4)
    monkeypatch.setattr(M, "materialise", lambda df, name: pytest.fail("a job a shard"))
    assert sorted(map(tuple, M.occurrences(texts, patterns).collect())) == whole and len(whole) == 8
