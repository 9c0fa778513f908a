"""Snapshot diffs: alignments against the plain table, hunks applied to the old text, renames, merge bases."""

import random
import re

import pytest

from tallyforge.operators import diff as D
from tallyforge.operators import snapshots as N


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("bits", [1 << 28, 16])
def test_matches(monkeypatch, bits):
    monkeypatch.setattr(N, "MOST_BITS", bits)
    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(0, 25))] for _ in range(2))
        m = N.matches(a, b)
        assert len(m) == longest(a, b) and all(a[i] == b[j] for i, j in m) and all(x < y and u < v for (x, u), (y, v) in zip(m, m[1:], strict=False))


def applied(old, text):
    """The new text that a file's diff makes of the old one."""
    old, out, at = N.split_lines(old), [], 0
    lines = text.split("\n")[:-1]
    for k, line in enumerate(lines):
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line):
            n = int(m[2] or 1)
            start = int(m[1]) - (n > 0)
            out += old[at:start]
            at = start
        elif line[:1] in "+- " and not line.startswith(("+++", "---")) and any(x.startswith("@@") for x in lines[:k]):
            full = line[1:] + ("" if k + 1 < len(lines) and lines[k + 1].startswith("\\") else "\n")
            if line[0] == "+":
                out.append(full)
            else:
                assert old[at] == full
                out += [full] * (line[0] == " ")
                at += 1
    return "".join(out + old[at:])


def test_hunks():
    r = random.Random(9)
    for _ in range(300):
        old = [f"{r.choice('abcdef')}\n" for _ in range(r.randint(0, 40))]
        new = [x for x in old if r.random() > 0.1]
        for _ in range(r.randint(0, 4)):
            new.insert(r.randint(0, len(new)), f"{r.choice('xyz')}\n")
        old, new = ("".join(x)[: -1 if r.random() < 0.3 else None] for x in (old, new))
        added, removed, text = N.unified("f", None, old, new, None)
        assert applied(old, text) == new
        a, b = N.split_lines(old), N.split_lines(new)
        assert (added, removed) == (len(b) - longest(a, b), len(a) - longest(a, b))


def test_long_texts():
    a = [f"{i % 997}\n" for i in range(20_000)]
    b = a[:5000] + ["new\n"] + a[5003:]
    assert len(N.matches(a, b)) == 19_997


def test_snapshots(spark):
    body = "".join(f"line {i} of a text\n" for i in range(40))
    base = [("same", "x\n"), ("edit", body), ("gone", "only here\n"), ("old/a", body + "tail a\n"), ("old/b", body.replace("text", "book")), ("bin", "a\0b"), ("null", None), ("twin1", "t\n"), ("twin2", "t\n")]
    head = [("same", "x\n"), ("edit", body.replace("line 7 ", "line seven ").replace("line 30 ", "")), ("come", "elsewhere\n"), ("new/a", body + "tail a\n"), ("new/b", body.replace("text", "book").replace("line 3 ", "3 ")), ("bin", "a\0c"), ("null", ""), ("twin3", "t\n")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string").repartition(2)
    rows = N.snapshot_diff(frame(base), frame(head)).collect()
    got = {r.path: (r.old_path, r.status, r.added, r.removed) for r in rows}
    assert got == {"edit": (None, "M", 2, 2), "gone": (None, "D", 0, 1), "come": (None, "A", 1, 0), "new/a": ("old/a", "R", 0, 0), "new/b": ("old/b", "R", 1, 1) if "new/b" in got and got["new/b"][2] == 1 else ("old/b", "R", 11, 11), "bin": (None, "M", 0, 0), "twin3": ("twin1", "R", 0, 0), "twin2": (None, "D", 0, 1)}
    text = {r.path: r.text for r in rows}
    assert applied(body, text["edit"]) == dict(head)["edit"] and text["edit"].count("@@ -") == 2 and "Binary files a/bin and b/bin differ" in text["bin"]
    assert text["new/a"] == "diff --git a/old/a b/new/a\nsimilarity index 100%\nrename from old/a\nrename to new/a\n"
    parsed = D.parse_diffs(N.snapshot_diff(frame(base), frame(head)).selectExpr("path AS diff_id", "text")).collect()
    assert {(r.path, r.status) for r in parsed} == {(p, s) for p, (_, s, _, _) in got.items()}
    assert sum(r.kind == "+" for r in parsed if r.path == "edit") == 2
    assert N.snapshot_diff(frame(base), frame(base)).collect() == []


def test_first_choices(spark):
    """Rounds of first choices against the walk in order."""
    r = random.Random(2)
    for n in (5, 40):
        pairs = list({(r.randrange(n), r.randrange(n)): r.randrange(4) for _ in range(4 * n)}.items())
        used, want = (set(), set()), []
        for (a, b), s in sorted(pairs, key=lambda x: (-x[1], x[0])):
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                want.append((a, b, s))
        df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs], "a int, b int, s int")
        from pyspark.sql import functions as F

        assert sorted(map(tuple, N.first_choices(df, "a", "b", [F.desc("s"), "a", "b"]).collect())) == sorted(want)


def test_merge_bases(spark):
    """A fork, a criss-cross merge (the newer base), unrelated histories, a commit and its own ancestor."""
    c = [("a", None, 1), ("b", "a", 2), ("c", "a", 3), ("d", "b", 4), ("d", "c", 4), ("e", "c", 5), ("e", "b", 5), ("z", None, 6)]
    q = [(1, "b", "c"), (2, "d", "e"), (3, "a", "z"), (4, "a", "d"), (5, "d", "d"), (6, None, "a")]
    df = N.merge_bases(spark.createDataFrame(c, "commit string, parent string, at int"), spark.createDataFrame(q, "pair_id int, base string, head string"))
    assert {r.pair_id: r.merge_base for r in df.collect()} == {1: "a", 2: "c", 3: None, 4: "a", 5: "d", 6: None}


def test_files_without_an_old_path_do_not_meet(spark):
    """The join of old texts has renames on its left only: nothing is outer-joined on the old path, null for most."""
    base = spark.createDataFrame([(f"p{i}", f"line {i}\nand {i}") for i in range(8)], "path string, text string")
    head = spark.createDataFrame([("q0", "line 0\nand 0"), *((f"p{i}", f"line {i}\nor {i}") for i in range(1, 8))], "path string, text string")
    got = N.snapshot_diff(base, head)
    assert sorted((r.path, r.old_path, r.status) for r in got.collect()) == [*((f"p{i}", None, "M") for i in range(1, 8)), ("q0", "p0", "R")]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert joins and not any("old_path" in x for x in joins)


def walked(gone, come):
    """Renames by all pairs: equal texts first, then by percent shared, old path, new path; each file once."""
    from collections import Counter

    bag = lambda text: Counter(N.split_lines(text))
    found = []
    for p, x in gone.items():
        for q, y in come.items():
            shared = sum(len(k.encode()) * n for k, n in (bag(x) & bag(y)).items())
            alike = 100 * shared // max(len(x.encode()), len(y.encode()))
            if alike >= N.ALIKE:
                found.append((x != y, -alike, p, q))
    out, used = [], (set(), set())
    for _, alike, p, q in sorted(found):
        if p not in used[0] and q not in used[1]:
            used[0].add(p)
            used[1].add(q)
            out.append((p, q, -alike))
    return sorted(out)


def renamed(spark, gone, come):
    frame = lambda files: spark.createDataFrame(list(files.items()), "path string, text string")
    return sorted(map(tuple, N.renames(frame(gone), frame(come)).collect()))


def test_renames_by_common_lines(spark):
    """What two files share is in many others too, or in none of their rarest lines: they are renames all the same."""
    head = "".join(f"a line {i} that all files have\n" for i in range(6))
    gone = {f"old/{i:03}": f"{head}own {i}\n" for i in range(140)}
    come = {f"new/{i:03}": f"{head}other {i}\n" for i in range(139)}
    # the 30 rarest lines of these two are in another file each, but not in each other
    rare = {s: [f"a rare and very long line {s} {i}{'.' * 20}\n" for i in range(30)] for s in "xy"}
    common = "".join(f"somewhat common line {i}{'-' * 60}\n" for i in range(40))
    gone |= {"old/moved": common + "".join(rare["x"]), "old/much": common + "much more\n" * 2000} | {f"old/y{i}": line + f"{i} alone here\n" * 99 for i, line in enumerate(rare["y"])}
    come |= {"new/moved": common + "".join(rare["y"])} | {f"new/x{i}": line + f"{i} alone there\n" * 99 for i, line in enumerate(rare["x"])}
    got = renamed(spark, gone, come)
    assert got == walked(gone, come) and len(got) == 140 and ("old/moved", "new/moved") in [g[:2] for g in got]


@pytest.mark.parametrize("many", [None, 0])
def test_renames_against_all_pairs(spark, monkeypatch, many):
    """Few lines and many ties, in one search and in steps: the same pairs as from a list of all."""
    if many is not None:
        monkeypatch.setattr(N, "MANY", many)
    r = random.Random(1)
    pool = [f"{'ab' * r.randint(0, 9)}{i}\n" for i in range(30)]

    def text(i):
        some = r.choices(pool[i % 3 * 10 : i % 3 * 10 + 12], k=r.randint(1, 9))
        return "".join(some) + ("é no end" if r.random() < 0.2 else f"{r.random()}\n" * r.randint(0, 2))

    gone, come = ({f"{s}{i}": text(i) for i in range(60)} for s in "pq")
    assert renamed(spark, gone, come) == walked(gone, come)
