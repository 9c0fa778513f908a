"""Unified diffs: parsing into lines, ranges, folding of deletions, and names at risk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.patterns import occurrences
from tallyforge.operators.text import secrets

LINES = "diff_id string, file int, path string, old_path string, status string, binary boolean, hunk int, pos int, kind string, old_line int, new_line int, text string"
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _path(text: str) -> str | None:
    name = text.split("\t")[0].strip()
    return None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


def parse_one(text: str) -> Iterator[tuple]:
    """Lines of one diff. The counts of a hunk's header say how many lines it has, so a deleted line that looks like a
    file header ("--- x") is still a deleted line."""
    file, head = -1, None
    hunk = old = new = old_left = new_left = pos = 0

    def row(kind: str | None, o: int | None, n: int | None, body: str | None) -> tuple:
        old_path, new_path, binary, status = head["old"], head["new"], head["binary"], head["status"]
        status = status or ("A" if old_path is None else "D" if new_path is None else "R" if old_path != new_path else "M")
        return (file, new_path or old_path, old_path if status == "R" else None, status, binary, hunk if kind else None, pos if kind else None, kind, o, n, body)

    for line in text.split("\n"):
        if old_left > 0 or new_left > 0:
            mark, body = line[:1] or " ", line[1:]
            if mark == "\\":
                continue
            if mark in "+- ":
                pos += 1
                yield row(mark, old if mark != "+" else None, new if mark != "-" else None, body)
                if mark != "+":
                    old, old_left = old + 1, old_left - 1
                if mark != "-":
                    new, new_left = new + 1, new_left - 1
                head["rows"] += 1
                continue
            old_left = new_left = 0
        if line.startswith("diff --git "):
            if head and not head["rows"]:
                yield row(None, None, None, None)
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            file += 1
            hunk = pos = 0
            head = {"old": m[1] if m else None, "new": m[2] if m else None, "binary": False, "status": None, "rows": 0}
        elif head is None and line.startswith("--- ") or head and head["rows"] and line.startswith("--- "):
            file += 1
            hunk = pos = 0
            head = {"old": _path(line[4:]), "new": None, "binary": False, "status": None, "rows": 0}
        elif head is None:
            continue
        elif line.startswith("--- "):
            head["old"] = _path(line[4:])
        elif line.startswith("+++ "):
            head["new"] = _path(line[4:])
        elif line.startswith("rename from "):
            head["old"], head["status"] = line[12:], "R"
        elif line.startswith("rename to "):
            head["new"], head["status"] = line[10:], "R"
        elif line.startswith("new file"):
            head["status"] = "A"
        elif line.startswith("deleted file"):
            head["status"] = "D"
        elif line.startswith(("Binary files ", "GIT binary patch")):
            head["binary"] = True
        elif m := _HUNK.match(line):
            hunk, pos = hunk + 1, 0
            old, new = int(m[1]), int(m[3])
            old_left, new_left = int(m[2] or 1), int(m[4] or 1)
    if head and not head["rows"]:
        yield row(None, None, None, None)


def parse_diffs(df: DataFrame, id_col: str = "diff_id", text_col: str = "text") -> DataFrame:
    """SC6, U1: one row per line (and one for a file without hunks); a diff is parsed within its row, so it scales with
    the number of diffs."""
    names = [x.split()[0] for x in LINES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b["id"], b["text"], strict=True) for r in parse_one(t or "")]
            out = pd.DataFrame(rows, columns=names)
            for c in ("file", "hunk", "pos", "old_line", "new_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, LINES)


def line_numbers(rows: DataFrame) -> DataFrame:
    """W6 over (diff_id, file, hunk, old_start, new_start, pos, kind): counters by running sums, no Python."""
    w = Window.partitionBy("diff_id", "file", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kinds: F.sum(F.col("kind").isin(*kinds).cast("int")).over(w) - 1
    return rows.withColumn("old_line", F.when(F.col("kind") != "+", F.col("old_start") + count(("-", " "))).cast("int")).withColumn(
        "new_line", F.when(F.col("kind") != "-", F.col("new_start") + count(("+", " "))).cast("int")
    )


def changed_ranges(lines: DataFrame) -> DataFrame:
    """Added and removed lines, and the span of new lines touched, per hunk."""
    return lines.filter("kind is not null").groupBy("diff_id", "path", "hunk").agg(
        F.count_if(F.col("kind") == "+").alias("added"),
        F.count_if(F.col("kind") == "-").alias("removed"),
        F.min(F.when(F.col("kind") == "+", F.col("new_line"))).alias("lo"),
        F.max(F.when(F.col("kind") == "+", F.col("new_line"))).alias("hi"),
    )


def fold_deletions(lines: DataFrame, most: int = 3) -> DataFrame:
    """Runs of more than `most` deleted lines become their first line, a marker and their last line."""
    w = Window.partitionBy("diff_id", "file", "hunk").orderBy("pos")
    same = Window.partitionBy("diff_id", "file", "hunk", "kind").orderBy("pos")
    runs = lines.filter("kind is not null").withColumn("run", F.row_number().over(w) - F.row_number().over(same))
    each = Window.partitionBy("diff_id", "file", "hunk", "kind", "run")
    runs = runs.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("i", F.row_number().over(each.orderBy("pos")))
    long = (F.col("kind") == "-") & (F.col("n") > most)
    runs = runs.filter(~long | (F.col("i") <= 2) | (F.col("i") == F.col("n")))
    text = F.when(long & (F.col("i") == 2) & (F.col("n") > 2), F.concat(F.lit("... "), (F.col("n") - 2).cast("string"), F.lit(" lines removed"))).otherwise(F.col("text"))
    return runs.withColumn("text", text).drop("run", "n", "i")


#: Lines that define a name, name a route, or hold a dotted path; the least length of a name.
DEFINITION = r"^[-+]\s*(?:export\s+)?(?:async\s+)?(?:def|class|function|const|let|var|interface|type|struct|func)\s+([A-Za-z_][\w]*)"
ROUTE = r"^[-+].*?['\"](/[A-Za-z0-9_./{}:-]{4,})['\"]"
DOTTED = r"['\"]([a-z][\w]*(?:\.[\w]+){2,})['\"]"
LEAST_NAME = 5


def candidates(line: Column) -> Column:
    """names that a changed line (its mark included) may break elsewhere: what it defines, a route, dotted paths."""
    found = F.concat(F.array(F.regexp_extract(line, DEFINITION, 1), F.regexp_extract(line, ROUTE, 1)), F.regexp_extract_all(line, F.lit(DOTTED), F.lit(1)))
    return F.filter(found, lambda n: (F.length(n) >= LEAST_NAME) & ~F.startswith(n, F.lit("_")))


def names_at_risk(lines: DataFrame) -> DataFrame:
    """Names that removed lines may break elsewhere (definitions, routes, dotted paths) and no added line has, with
    how often, in order of first removal."""
    changed = lines.filter("kind IN ('-', '+')")
    found = changed.select("diff_id", "kind", "file", "hunk", "pos", F.posexplode(candidates(F.concat("kind", "text"))).alias("place", "name"))
    removed = found.filter("kind = '-'").groupBy("diff_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "hunk", "pos", "place")).alias("first"))
    return removed.join(found.filter("kind = '+'").select("diff_id", "name"), ["diff_id", "name"], "left_anti").select("diff_id", "name", "n", F.row_number().over(Window.partitionBy("diff_id").orderBy("first")).alias("ordinal"))


def added_secrets(lines: DataFrame) -> DataFrame:
    """S-SECRET over parsed lines: what a change adds that looks like a secret, with its place in the new file."""
    place = F.struct("diff_id", "path", F.col("new_line").alias("line")).alias("place")
    return secrets(lines.filter("kind = '+'").select(place, "text"), "place", "text").select("place.*", "rule", "redacted", "severity", "category", "detector")


def siblings(lines: DataFrame, files: DataFrame) -> DataFrame:
    """J22 over (diff_id, path, text) and (path): other files that a diff's text names: their stem, or their path without suffix
    as a dotted module, is a substring of it. All names are searched for at once; no diff is paired with a file it doesn't name."""
    path = F.col("path")
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.[^.]*$", "")
    module = F.translate(F.regexp_replace(path, "\\.[^.]*$", ""), "/", ".")
    named = files.select(path.alias("sibling"), F.explode(F.array_distinct(F.array(stem, module))).alias("pattern")).distinct()
    hits = occurrences(lines.select(F.col("diff_id").alias("key"), "text").distinct(), named).distinct()
    own = lines.select("diff_id", path.alias("sibling")).distinct()
    found = hits.join(named, "pattern").select(F.col("key").alias("diff_id"), "sibling").distinct()
    return found.join(own, ["diff_id", "sibling"], "left_anti")
