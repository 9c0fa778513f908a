"""Symbols, imports and calls of source files, and chunks by symbol."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import graph as G
from tallyforge.operators import lexers
from tallyforge.operators import text as T
from tallyforge.sources.store import materialise

#: Fixed value: characters of a signature.
SIGNATURE_CHARS = 200
#: Tasks that files are dealt to, for each core.
TASKS_A_CORE = 8

FACTS = "path string, fact string, name string, qualified_name string, kind string, start_line int, end_line int, start_byte int, end_byte int, lang string, signature string"


def python_facts(text: str) -> Iterator[tuple]:
    """Symbols, imports and calls of Python by its own parser; a file that doesn't parse has none."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = text.encode().split(b"\n")
    begin = [0]
    for x in lines:
        begin.append(begin[-1] + len(x) + 1)

    whole = text.encode()

    def span(n: ast.AST) -> tuple[int, int, int, int]:
        return n.lineno, n.end_lineno, begin[n.lineno - 1] + n.col_offset, begin[n.end_lineno - 1] + n.end_col_offset

    def callee(n: ast.expr, name: str) -> tuple[int, int, int, int]:
        end = begin[n.end_lineno - 1] + n.end_col_offset
        return n.end_lineno, n.end_lineno, end - len(name.encode()), end

    def visit(node: ast.AST, owner: str) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{owner}.{n.name}" if owner else n.name
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                head = whole[span(n)[2] : span(n.body[0])[2] - (getattr(n.body[0], "decorator_list", []) and span(n.body[0])[2] - span(n.body[0].decorator_list[0])[2] + 1 or 0)]
                yield ("symbol", n.name, inner, kind, *span(n), "python", " ".join(head.decode("utf-8", "replace").split()))
            elif isinstance(n, ast.Import):
                for a in n.names:
                    yield ("import", a.name, None, "import", *span(n), "python", None)
            elif isinstance(n, ast.ImportFrom):
                yield ("import", "." * n.level + (n.module or ""), None, "import", *span(n), "python", None)
            elif isinstance(n, ast.Call):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                if name:
                    yield ("call", name, None, "call", *callee(n.func, name), "python", None)
            yield from visit(n, inner)

    yield from visit(module, "")


def file_facts(path: str, text: str) -> Iterator[tuple]:
    """Facts of a file by its suffix; none of a language that isn't known."""
    lang = T.LANGUAGES.get(m[0].lower()) if (m := re.search(r"(?<=[^/])\.[^./]+$", path)) else None
    if lang == "python":
        return python_facts(text)
    return lexers.facts(text, lang) if lang else iter(())


def extract(files: DataFrame) -> DataFrame:
    """Facts of (path, text): one row per symbol, import and call, with lines and bytes of the whole file. A file is read
    within its row; signatures are cut to SIGNATURE_CHARS. Files are dealt to tasks in turn first, as a small file of keys may stand for
    much to read; facts are written, so that they are made once however often they are read."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *f[:-1], f[-1] and f[-1][:SIGNATURE_CHARS]) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in file_facts(p, t)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    parts = TASKS_A_CORE * max(files.sparkSession.sparkContext.defaultParallelism, 1)
    dealt = files.filter("text IS NOT NULL AND path IS NOT NULL").select("path", "text").repartition(parts)
    return materialise(dealt.mapInArrow(run, FACTS), "facts")


def symbol_rows(facts: DataFrame) -> DataFrame:
    """SK2, R9, F16: symbols keyed by path, qualified name and place, with their parent (the innermost around them in their file)
    and their signature: the text before the body, its white space evened out."""
    s = facts.filter("fact = 'symbol'").withColumn("symbol_id", F.concat("path", F.lit("::"), "qualified_name", F.lit("@"), F.col("start_byte").cast("string")))
    return G.nesting(s.dropDuplicates(["symbol_id"])).drop("fact")


def symbol_chunks(files: DataFrame, facts: DataFrame) -> DataFrame:
    """A chunk per top-level symbol, and the lines before the first one, without a symbol; short ones are dropped, long ones
    cut.

    Files and their symbols meet on the path; bodies are sliced from the file's own lines."""
    key = F.concat("path", F.lit("::"), "qualified_name", F.lit("@"), F.col("start_byte").cast("string"))
    top = facts.filter("fact = 'symbol' AND qualified_name = name").select("path", F.struct("start_line", "end_line", key.alias("symbol_id")).alias("c"))
    ahead = top.groupBy("path").agg((F.min("c.start_line") - 1).cast("int").alias("end_line")).filter("end_line > 0")
    places = top.unionByName(ahead.select("path", F.struct(F.lit(1).alias("start_line"), "end_line", F.lit(None).cast("string").alias("symbol_id")).alias("c")))
    j = files.select("path", F.split("text", "\n").alias("l")).join(places, "path")
    j = j.select("path", "c.*", F.array_join(F.slice("l", F.col("c.start_line"), F.col("c.end_line") - F.col("c.start_line") + 1), "\n").alias("whole"))
    j = j.withColumn("body", T.chunk_body(F.col("whole"))).filter("body IS NOT NULL")
    return j.select("path", "symbol_id", "start_line", "end_line", "body", F.sha2(F.concat("path", F.lit(":"), "body"), 256).alias("content_hash"), T.token_estimate(F.col("body")).alias("token_estimate"))


def chunks(files: DataFrame, facts: DataFrame) -> DataFrame:
    """U3 over all files: by symbol, and by windows of lines where a file has no top-level symbol."""
    top = facts.filter("fact = 'symbol' AND qualified_name = name").select("path").distinct()
    windows = T.window_chunks(files.join(top, "path", "left_anti"), "path", "text").withColumn("symbol_id", F.lit(None).cast("string"))
    by_symbol = symbol_chunks(files, facts)
    return by_symbol.unionByName(windows.select(by_symbol.columns))
