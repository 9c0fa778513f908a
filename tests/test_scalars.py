"""Scalar expressions and index operators on literals."""

from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators import index as I


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_scalars(spark):
    s = lambda x: F.lit(x)
    assert one(spark, X.repository(s("git@Host.org:Own/Repo.git")), X.repository(s("https://u:p@host.org/own/repo/")), X.repository(s("ssh://git@host.org:22/own/repo.git"))) == ("host.org/own/repo",) * 3
    assert one(spark, X.diff_path(s("--- a/x/y.py\t2024")), X.diff_path(s("+++ /dev/null")), X.diff_path(s("+++ b/z"))) == ("x/y.py", None, "z")
    assert one(spark, X.fill_template(s("a {{x}} {{y}} {{z}}"), {"x": s("1"), "y": s(None).cast("string")})) == ("a 1  ",)
    assert one(spark, X.context_label({"diff": s(True), "call graph": s(False), "siblings": s(True)})) == ("diff+siblings",)
    assert one(spark, X.dotted_module(s("a/b.c/d.py")), X.suffix_language_group(s("a.tsx")), X.suffix_language_group(s("A.PY"))) == ("a.b.c.d", "web", None)
    assert one(spark, F.length(X.review_id(s("a"), s("b"), s("c")))) == (16,)


def test_unresolve_and_similar(spark):
    edges = spark.createDataFrame([(1, 2, "local"), (2, 3, "global"), (4, None, "text")], "src int, dst int, resolution string")
    got = sorted(((r.src, r.dst, r.resolution) for r in I.unresolve(edges, spark.createDataFrame([(3,), (1,)], "symbol_id int")).collect()), key=str)
    assert got == [(2, None, "global"), (4, None, "text")]
    near = spark.createDataFrame([("u", 1, 10), ("u", 2, 11), ("u", 3, 12)], "unit string, rank int, chunk_id int")
    chunks = spark.createDataFrame([(10, "own"), (12, "other")], "chunk_id int, path string")
    own = spark.createDataFrame([("u", "own")], "unit string, path string")
    assert [r.chunk_id for r in I.similar_code(own, near, chunks, own).collect()] == [12]
