"""Operators without a driver table: literal fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import context as C
from tallyforge.operators import evals as E
from tallyforge.operators import findings as O
from tallyforge.operators import planning as P
from tallyforge.operators import posting as G
from tallyforge.operators import queue as Q
from tallyforge.operators import symbols as S
from tallyforge.operators import text as T
from tallyforge.sources import files as X

PY = '"""Doc."""\nimport os\nfrom .a import b\n\nclass Box:\n    def size(self):\n        return compute(os.path)\n\n\ndef compute(x):\n    return b(x)\n'
JS = "import x from './x';\nexport class A {\n  m() { return call(1); }\n}\nfunction run() { if (a) { b(); } }\nconst q = require('fs');\n"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_symbols(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.js", JS), ("bad.py", "def ("), ("none.go", None), ("empty.py", "")], "path string, text string")
    facts = S.extract(files)
    got = {(r.path, r.fact, r.name, r.qualified_name, r.kind, r.start_line, r.end_line) for r in facts.collect()}
    assert ("a.py", "symbol", "size", "Box.size", "function", 6, 7) in got and ("a.py", "symbol", "compute", "compute", "function", 10, 11) in got
    assert {n for p, f, n, *_ in got if p == "a.py" and f == "import"} == {"os", ".a"} and {n for p, f, n, *_ in got if p == "a.py" and f == "call"} == {"compute", "b"}
    assert ("b.js", "symbol", "A", "A", "class", 2, 4) in got and ("b.js", "symbol", "run", "run", "function", 5, 5) in got
    assert {n for p, f, n, *_ in got if p == "b.js" and f == "import"} == {"./x"}
    chunks = {(r.path, r.symbol_id, r.start_line, r.end_line) for r in S.symbol_chunks(files, facts).collect()}
    assert ("a.py", "a.py::Box@39", 5, 7) in chunks and {(r.path, r.symbol_id, r.start_line, r.end_line) for r in S.chunks(files, facts).collect()} == chunks
    assert not {c for c in chunks if c[1] is None}  # under LEAST_CHARS


def test_symbol_rows(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.js", JS)], "path string, text string")
    got = {(r.path, r.qualified_name): (r.parent_id, r.signature) for r in S.symbol_rows(S.extract(files)).collect()}
    assert got["a.py", "Box.size"] == ("a.py::Box@39", "def size(self):") and got["a.py", "compute"] == (None, "def compute(x):")
    assert got["b.js", "run"] == (None, "function run()")
    wide = "// é\n" * 20_000 + "function f() { g({}) }\n" * 2000
    assert sum(f[0] == "symbol" for f in S.file_facts("w.js", wide)) == 2000


def test_ignore_rules(spark):
    rules = spark.createDataFrame([(1, "*.log", "own"), (2, "build/", "own"), (3, "!keep.log", "own"), (4, "/top.txt", "own"), (5, "a/**/z", "own")], "ordinal int, pattern string, source string")
    paths = ["x.log", "d/x.log", "d/keep.log", "build/x", "d/build/y", "build", "top.txt", "d/top.txt", "a/z", "a/b/c/z", "a/b/zz"]
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, size long")
    got = {r.path for r in T.ignore_reasons(files, rules).filter("ignored is not null").collect()}
    assert got == {"x.log", "d/x.log", "build/x", "d/build/y", "top.txt", "a/z", "a/b/c/z"}


def test_globs():
    import re

    p = re.compile(T.glob_pattern(["tests/*", "**/test_*", "*.md"]))
    assert [bool(p.match(x)) for x in ("tests/a/b.py", "test_x.py", "a/test_x.py", "conftest.py", "x.md")] == [True, False, True, False, True]


def test_planning(spark):
    paths = spark.createDataFrame([(1, "a"), (1, "b"), *((2, p) for p in "abcd")], "review_id long, path string")
    proposed = spark.createDataFrame([(2, 0, "a"), (2, 1, "zz"), (2, 2, "b"), (2, 2, "a")], "review_id long, ordinal int, path string")
    assert rows(P.plan_units(paths, proposed)) == sorted([(1, "unit-1", "a"), (1, "unit-1", "b"), (2, "unit-1", "a"), (2, "unit-3", "a"), (2, "unit-3", "b"), (2, "remaining files", "c"), (2, "remaining files", "d")], key=str)
    df = spark.createDataFrame([("p1", "0.7"), (" P4 ", "7"), (None, "NaN"), ("P0", None), ("P2", "-1"), ("x", "0.5f"), ("P5", " 1e-1 "), ("P5", "-inf")], "s string, c string")
    assert [tuple(r) for r in df.select(P.coerced_severity(F.col("s")), P.coerced_confidence(F.col("c"))).collect()] == [("P1", 0.7), ("P3", 1.0), ("P3", 1.0), ("P0", 0.5), ("P2", 0.0), ("P3", 0.5), ("P5", 0.1), ("P5", 0.0)]


def test_loose_lists(spark):
    good = '[{"a": 1}, {"a": 2}]'
    df = spark.createDataFrame([(1, good), (2, json.dumps(good)), (3, good + " trailing junk"), (4, "no list"), (5, None)], "k int, t string")
    assert sorted((r.k, r.entry.a) for r in P.split_lists(df, "k", "t", "struct<a: int>").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_posting(spark):
    lines = spark.createDataFrame([("f", 10), ("f", 20), ("f", None)], "path string, new_line int")
    found = spark.createDataFrame([(1, [("x", 1), ("f", 15)]), (2, [("x", 1)]), (3, [("f", 19), ("f", 10)])], "finding_id int, locations array<struct<file: string, line: int>>")
    assert rows(G.anchors(found, lines)) == [(1, "f", 10), (2, None, None), (3, "f", 20)]
    a, b, c, d = ("a" * 32, "b" * 32, "c" * 32, "d" * 32)
    comments = spark.createDataFrame([(1, f"<!-- bot:{a} -->"), (2, f"x <!-- bot:{a}:resolved -->"), (3, f"<!-- bot:{b} -->"), (4, f"<!-- bot:{c} -->"), (5, "none")], "comment_id int, body string")
    posted = G.markers(comments, "bot")
    assert rows(posted) == [(a, 2, True), (b, 3, False), (c, 4, False)]
    now = spark.createDataFrame([(c,), (d,)], "fingerprint string")
    assert rows(G.posting_plan(now, posted, spark.createDataFrame([], "fingerprint string"))) == [(b, "fixed"), (d, "post")]


def test_queue(spark):
    old = spark.createDataFrame([("k", 1, "a")], "key string, ver int, v string")
    new = spark.createDataFrame([("k", 2, "b"), ("n", 1, "c"), ("n", 1, "d")], "key string, ver int, v string")
    assert rows(Q.insert_or_ignore(old, new, ["key"], ["v"])) == [("k", 1, "a"), ("n", 1, "c")]
    assert rows(Q.replace_by_key(old, new.filter("key = 'k'"), "key")) == [("k", 2, "b")]
    comments = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "number long, id long")
    fresh, marks = Q.comment_marks(comments, spark.createDataFrame([(1, 6)], "number long, mark long"))
    assert rows(fresh) == [(1, 9)] and rows(marks) == [(1, 9), (2, 3)]
    body = spark.createDataFrame([("@bot review it",), ("hi @Bot: explain",), ("@bottle review",), ("@bot-x review",), ("@bot",), ("reviewed",)], "b string")
    assert [r[0] for r in body.select(Q.command(F.col("b"), "bot")).collect()] == ["review", "explain", None, None, "other", None]


def test_budgets(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 9, 3, 4, 1])], "u int, o int, c long")
    assert [r.o for r in C.break_at_first_miss(df, "u", ["o"], "c", 10).orderBy("o").collect()] == [0]
    assert [r.o for r in C.skip_and_continue(df, "u", "o", "c", 10).orderBy("o").collect()] == [0, 2, 4]


def test_verification(spark):
    f = spark.createDataFrame([(i, 500, 2) for i in range(5)], "finding_id int, conf long, level int")
    v = spark.createDataFrame([(0, "confirm", None, None, None), (1, "reject", None, 200, "r" * 39), (2, "reject", None, 100, "r" * 40), (3, "reject", None, None, "Let me " + "r" * 40)], "finding_id int, verdict string, level int, conf long, reason string")
    assert rows(O.verify_fold(f, v).select("finding_id", "conf", "status")) == [(0, 600, "kept"), (1, 200, "kept"), (2, 100, "rejected"), (3, 500, "kept"), (4, 500, "kept")]


def test_evals(spark):
    wanted = "case_id string, no long, file string, pattern string, category string, severity string"
    expect = spark.createDataFrame([("c", 0, "f", "over", None, "P1"), ("c", 1, "f", "OVER|off", None, "P0"), ("c", 2, "", "body only$", "bug", None), ("d", 0, "f", "x", None, None)], wanted)
    forbid = spark.createDataFrame([("c", 0, None, "run", None, None), ("c", 1, "g", "overrun", "other", None), ("e", 0, "f", "x", None, None)], wanted)
    found = [("c", 0, "f", "bug", "P1", "Overrun", "b"), ("c", 1, "f", "bug", "P1", "off by one", None), ("c", 2, "g", "bug", "P2", "overrun", "in the body only"), ("e", 0, "f", "bug", "P0", "y", "z")]
    findings = spark.createDataFrame(found, "case_id string, finding_no long, file string, category string, severity string, title string, body string")
    assert rows(E.match_expectations(expect, findings).select("case_id", "no", "finding_no")) == [("c", 0, 0), ("c", 1, 1), ("c", 2, 2)]
    cases = spark.createDataFrame([("c",), ("d",), ("e",)], "case_id string")
    assert rows(E.eval_scores(cases, expect, forbid, findings)) == [("c", 3, 0, 0, 2, 1, False), ("d", 0, 1, 0, 0, 0, False), ("e", 0, 0, 1, 0, 0, True)]


def test_evals_in_order(spark):
    """The walk against its definition, and a case of a million pairs."""
    import random

    r = random.Random(6)
    wanted = [(f"c{r.randrange(4)}", no, "f", r.choice(["a", "b", "a|b", "q", "c"]), None, None) for no in range(60)]
    found = [(f"c{r.randrange(4)}", no, "f", "bug", "P1", r.choice("abc"), "") for no in range(70)]
    used, want = set(), []
    for c, no, _, p, *_ in wanted:
        hit = next((f[1] for f in found if f[0] == c and (c, f[1]) not in used and f[5] in p.split("|")), None)
        if hit is not None:
            used.add((c, hit))
            want.append((c, no, hit))
    e = spark.createDataFrame(wanted, "case_id string, no long, file string, pattern string, category string, severity string")
    f = spark.createDataFrame(found, "case_id string, finding_no long, file string, category string, severity string, title string, body string")
    assert rows(E.match_expectations(e, f).select("case_id", "no", "finding_no")) == sorted(want, key=str)
    many = spark.range(1000)
    e = many.selectExpr("'c' AS case_id", "id AS no", "'f' AS file", "'x' AS pattern", "CAST(NULL AS string) AS category", "CAST(NULL AS string) AS severity")
    f = many.selectExpr("'c' AS case_id", "id AS finding_no", "'f' AS file", "'bug' AS category", "'P1' AS severity", "'x' AS title", "'' AS body")
    assert E.match_expectations(e, f).filter("no = finding_no").count() == 1000


@pytest.mark.parametrize("times", [1, 2])
def test_files(spark, tmp_path, times):
    top = tmp_path / "top"
    (top / "sub").mkdir(parents=True)
    (top / "a.txt").write_text("text")
    (top / "sub" / "b.bin").write_bytes(b"x\0y")
    got = {r.path: (r.size, r.binary) for r in X.tree(spark, str(top)).collect()}
    assert got == {"a.txt": (4, False), "sub/b.bin": (3, True)}
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "one", "diff": "d", "expect": [{"file": "f", "pattern": "p"}], "forbid": []}]}))
    cases, expect, forbid = X.golden_cases(spark, str(tmp_path / "cases.json"))
    assert cases.count() == 1 and expect.first().pattern == "p" and forbid.count() == 0
    for i in range(times):
        X.swap(spark.createDataFrame([(i,)], "x int"), str(tmp_path / "t"))
    assert X.read_latest(spark, str(tmp_path / "t")).first().x == times - 1


def test_hash_embedding_reads_a_text_once(spark):
    from tallyforge.operators import review as R

    df = spark.createDataFrame([(1, "a a B_1 x " * 3000), (2, "?!"), (3, None), (4, "é b")], "id long, text string")
    v = df.select("id", R.hash_embedding(F.col("text")).alias("v"))
    assert v._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {x.id: x.v for x in v.collect()}
    assert got[2] == [0.0] * 16 and got[3] == [None] * 16 and all(abs(sum(x * x for x in got[i]) - 1) < 1e-9 for i in (1, 4))
    for i, words in ((1, ["a", "a", "b_1", "x"]), (4, ["b"])):
        raw = [0] * 16
        for h in (x.h for x in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()):
            raw[h % 16] += -1 if (h >> 32) % 2 else 1
        n = sum(x * x for x in raw) ** 0.5
        assert all(abs(a - b / n) < 1e-9 for a, b in zip(got[i], raw, strict=True))


def test_facts_are_made_once_by_several_tasks(spark):
    files = spark.createDataFrame([(f"m{i}.py", f"def f{i}():\n    g()\n") for i in range(200)], "path string, text string").coalesce(1)
    facts = S.extract(files)
    assert facts.count() == 400 and "MapIn" not in facts._jdf.queryExecution().executedPlan().toString()
    assert facts.select(F.input_file_name()).distinct().count() > 1
