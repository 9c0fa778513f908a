"""Diff parsing, folding, names at risk."""

from tallyforge.operators import diff as D

TEXT = """diff --git a/src/a.py b/src/a.py
index 1..2 100644
--- a/src/a.py
+++ b/src/a.py
@@ -1,7 +1,4 @@ def head():
 keep
-def compute_total(x):
--- looks like a header
-    two
-    three
-    four
+def other_name(x):
 tail
\\ No newline at end of file
@@ -20 +17,2 @@
 one
+def added_later():
diff --git a/old.txt b/new.txt
similarity index 100%
rename from old.txt
rename to new.txt
diff --git a/img.png b/img.png
new file mode 100644
Binary files /dev/null and b/img.png differ
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,1 +0,0 @@
-def compute_total(y):
"""


def parsed(spark):
    return D.parse_diffs(spark.createDataFrame([("d", TEXT), ("empty", ""), ("none", None), ("bare", "--- a/x\n+++ b/x\n@@ -5 +5 @@\n-o\n+n")], "diff_id string, text string"))


def test_lines(spark):
    rows = [r for r in parsed(spark).collect() if r.diff_id == "d"]
    heads = {(r.file, r.path, r.old_path, r.status, r.binary) for r in rows}
    assert heads == {(0, "src/a.py", None, "M", False), (1, "new.txt", "old.txt", "R", False), (2, "img.png", None, "A", True), (3, "gone.py", None, "D", False)}
    first = sorted((r.hunk, r.pos, r.kind, r.old_line, r.new_line, r.text) for r in rows if r.file == 0)
    assert first[0] == (1, 1, " ", 1, 1, "keep") and first[2] == (1, 3, "-", 3, None, "-- looks like a header")
    assert first[6] == (1, 7, "+", None, 2, "def other_name(x):") and first[7] == (1, 8, " ", 7, 3, "tail")
    assert [x[:5] for x in first[8:]] == [(2, 1, " ", 20, 17), (2, 2, "+", None, 18)]


def test_bare_and_empty(spark):
    rows = parsed(spark).collect()
    assert {r.diff_id for r in rows} == {"d", "bare"}
    assert sorted((r.path, r.kind, r.old_line, r.new_line) for r in rows if r.diff_id == "bare") == [("x", "+", None, 5), ("x", "-", 5, None)]


def test_numbers_agree_with_windows(spark):
    lines = parsed(spark).filter("kind is not null")
    starts = spark.createDataFrame([("d", 0, 1, 1, 1), ("d", 0, 2, 20, 17), ("d", 3, 1, 1, 0), ("bare", 0, 1, 5, 5)], "diff_id string, file int, hunk int, old_start int, new_start int")
    again = D.line_numbers(lines.drop("old_line", "new_line").join(starts, ["diff_id", "file", "hunk"]))
    key = ["diff_id", "file", "hunk", "pos", "old_line", "new_line"]
    assert sorted(map(str, again.select(key).collect())) == sorted(map(str, lines.select(key).collect()))


def test_fold_ranges_names(spark):
    lines = parsed(spark).filter("diff_id = 'd'")
    folded = [r.text for r in D.fold_deletions(lines).filter("file = 0 and hunk = 1").orderBy("pos").collect()]
    assert folded == ["keep", "def compute_total(x):", "... 3 lines removed", "    four", "def other_name(x):", "tail"]
    r = {(x.path, x.hunk): (x.added, x.removed, x.lo, x.hi) for x in D.changed_ranges(lines).collect()}
    assert r["src/a.py", 1] == (1, 5, 2, 2) and r["gone.py", 1] == (0, 1, None, None)
    assert [tuple(x) for x in D.names_at_risk(lines).collect()] == [("d", "compute_total", 2, 1)]


def test_siblings(spark):
    files = spark.createDataFrame([("lib/other_name.py",), ("src/a.py",), ("lib/keep.js",), ("x/abc.py",), ("lib/ompute_tot.go",), ("b.c/d/e.f.py",)], "path string")
    lines = parsed(spark).filter("diff_id = 'd'").select("diff_id", "path", "text").union(spark.createDataFrame([("d", "src/a.py", "from b.c.d.e.f import x")], "diff_id string, path string, text string"))
    assert sorted(r.sibling for r in D.siblings(lines, files).collect()) == ["b.c/d/e.f.py", "lib/keep.js", "lib/ompute_tot.go", "lib/other_name.py"]
