"""Comments as they are posted: literal texts and odd rows."""

import textwrap

from tallyforge.operators import posting as T

FOUND = "finding_id int, fingerprint string, severity string, category string, title string, body string, patch string, conf int, locations array<struct<file: string, line_start: int, line_end: int>>, inline boolean"


def bodies(spark, *rows):
    return {r.finding_id: r.markdown for r in T.comment_bodies(spark.createDataFrame(list(rows), FOUND), "bot").collect()}


def test_comment_bodies(spark):
    long = "well-known words, " * 20 + "x" * 200 + "\n\n tail"
    got = bodies(
        spark,
        (1, "ab", "P1", "bug", "t", long, "a\n  b\n", 925, [("f", 3, 4), ("g", None, None)], True),
        (2, "cd", "P2", "bug", "t", "b", "a\n", 935, [("f", 3, 4)], False),
        (3, None, None, None, None, None, None, None, None, None),
        (4, "ef", "P0", "bug", "t", "", "a\n\n", 5, [("f", 7, 0)], True),
    )
    brief = ["Fix this in the repository. Change nothing else.", "", "f:3-4", "g", "[P1 bug] t", *textwrap.wrap(" ".join(long.split()), width=88), "suggested replacement:", "a", "  b"]
    lines = ["**P1 — t**", "", long, "", "```suggestion", "a", "  b", "```", "", "<details>", "<summary>For a coding agent</summary>", "", "```", *brief, "```", "", "</details>", "", "<sub>bug · confidence 92% · reply if this is wrong</sub>", "<!-- bot:ab -->"]
    assert got[1] == "\n".join(lines)
    assert got[2] == "`f:3`\n**P2 — t**\n\nb\n\n```\na\n```\n\n<sub>bug · confidence 94%</sub>\n<!-- bot:cd -->"
    assert got[3] == "** — **\n\n\n\n<sub> · confidence 0%</sub>\n<!-- bot: -->"
    assert "```\na\n```" in got[4] and "suggestion\n" not in got[4] and "confidence 0%" in got[4]


def test_comment_ranges(spark):
    lines = spark.createDataFrame([("f", 3), ("f", 4), ("f", 6), ("f", None), ("g", 1)], "path string, new_line int")
    rows = [(1, [("f", 3, 4)]), (2, [("f", 2, 4)]), (3, [("f", 4, 5)]), (4, [("x", 1, 1), ("g", None, None)]), (5, []), (6, None), (7, [("f", 6, 6)])]
    found = spark.createDataFrame(rows, "finding_id int, locations array<struct<file: string, line_start: int, line_end: int>>")
    got = {r.finding_id: (r.path, r.line, r.start_line) for r in T.comment_ranges(found, lines).collect()}
    assert got == {1: ("f", 4, 3), 2: ("f", 4, None), 3: ("f", 4, None), 4: ("g", 1, None), 5: (None, None, None), 6: (None, None, None), 7: ("f", 6, None)}


def test_events_and_settled(spark):
    r = spark.createDataFrame([(1, "request_changes", None, 0), (2, "request_changes", "request_changes", 0), (3, "approve", None, 0), (4, "request_changes", "request_changes", 2), (5, None, None, None), (6, "comment", "x", 1)], "review_id int, verdict string, last_verdict string, comments int")
    got = {x.review_id: (x.blocking, x.posted, x.event) for x in T.review_events(r).collect()}
    assert got == {1: (True, True, "REQUEST_CHANGES"), 2: (False, False, None), 3: (False, False, None), 4: (False, True, "REQUEST_CHANGES"), 5: (False, False, None), 6: (False, True, "COMMENT")}
    plan = spark.createDataFrame([("a", "fixed", "0123456789"), ("b", "withdrawn", None), ("c", "post", "x")], "fingerprint string, action string, sha string")
    comments = spark.createDataFrame([("a", "x **P1 — one** **P2 — two**", "u"), ("b", None, ""), ("c", "", "u")], "fingerprint string, body string, url string")
    assert {x.line for x in T.settled_lines(plan, comments, plan["sha"]).collect()} == {"- [one](u) — fixed in `0123456`", "- a finding — withdrawn"}
