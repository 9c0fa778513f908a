"""Differences of two snapshots as unified diffs: merge bases, renames by shared lines, hunks by longest common subsequences."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.store import materialise

#: Lines of context, bytes in which a NUL makes a file binary, and the similarity (percent) of a rename.
CONTEXT, SNIFFED, ALIKE = 3, 8000, 50
#: Meetings of lines beyond which renames are first looked for from high similarities down, and these similarities (percent).
#: They decide the order of the work only, not what is found.
MANY, STEPS = 5_000_000, (95, 85, 75, 65)
#: Larger than any file.
_NONE = 1 << 62
#: Bits of the table of one alignment; longer texts are halved.
MOST_BITS = 1 << 28
_DIFFS = "path string, old_path string, status string, added long, removed long, text string"


def merge_bases(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """SC3's three dots over (commit, parent, at) and (pair_id, base, head): the newest of the best common ancestors of each pair,
    null without any. Ancestors are found by rounds over sets for all pairs at once, each written."""
    up = commits.select(F.col("commit").alias("at"), "parent").filter("parent IS NOT NULL").distinct()
    seen = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("base").alias("at")), F.struct(F.lit(1).alias("side"), F.col("head").alias("at")))).alias("x"))
    new = seen = materialise(seen.select("pair_id", "x.*").filter("at IS NOT NULL").distinct(), "ancestors")
    while new.limit(1).count():
        step = new.join(up, "at").select("pair_id", "side", F.col("parent").alias("at")).distinct()
        new = materialise(step.join(seen, ["pair_id", "side", "at"], "left_anti"), "ancestors")
        seen = seen.unionByName(new)
    common = materialise(seen.groupBy("pair_id", "at").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n"), "common")
    older = common.join(up, "at").select("pair_id", F.col("parent").alias("at"))
    best = common.join(older, ["pair_id", "at"], "left_anti").join(commits.select(F.col("commit").alias("at"), F.col("at").alias("when")).distinct(), "at", "left")
    newest = best.groupBy("pair_id").agg(F.max_by("at", F.struct("when", "at")).alias("merge_base"))
    return pairs.join(newest, "pair_id", "left")


def _bits(a: list, b: list) -> list[int]:
    """After each item of `a` a row of bits: those that are zero are where the subsequence with `b` grows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
        rows.append(v)
    return rows


def _lengths(a: list, b: list) -> list[int]:
    """The length of the longest common subsequence of `a` with each beginning of `b`."""
    v = _bits(a, b)[-1] if a else (1 << len(b)) - 1
    out = [0]
    for bit in reversed(bin(v | 1 << len(b))[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Items of only one side can't match and are left out first; a table of bits
    gives the rest, halved where it would be too large."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    ins, outs = set(a[first : len(a) - last]), set(b[first : len(b) - last])
    x = [i for i in range(first, len(a) - last) if a[i] in outs]
    y = [j for j in range(first, len(b) - last) if b[j] in ins]
    ends = [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]
    return [*((i, i) for i in range(first)), *((x[i], y[j]) for i, j in _aligned([a[i] for i in x], [b[j] for j in y])), *ends]


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:])]
    rows, out = _bits(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def split_lines(text: str) -> list[str]:
    """Lines with their ends; the last may lack its."""
    parts = text.split("\n")
    return [f"{x}\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def hunks(old: list[str], new: list[str], context: int = CONTEXT) -> tuple[list[str], int, int]:
    """Hunks of a unified diff, and how many lines were added and removed. In a change, what goes comes before what comes."""
    same = [*matches(old, new), (len(old), len(new))]
    changes, i, j = [], 0, 0
    for x, y in same:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out: list[str] = []
    put = lambda mark, line: out.append(f"{mark}{line[:-1]}" if line.endswith("\n") else f"{mark}{line}\n\\ No newline at end of file")
    side = lambda at, n: f"{at + (n > 0)}" + ("" if n == 1 else f",{n}")
    for g in groups:
        lead = min(context, g[0][0], g[0][2])
        tail = min(context, len(old) - g[-1][1])
        a, b = g[0][0] - lead, g[0][2] - lead
        out.append(f"@@ -{side(a, g[-1][1] + tail - a)} +{side(b, g[-1][3] + tail - b)} @@")
        for i1, i2, j1, j2 in g:
            for line in old[a:i1]:
                put(" ", line)
            for line in old[i1:i2]:
                put("-", line)
            for line in new[j1:j2]:
                put("+", line)
            a = i2
        for line in old[a : a + tail]:
            put(" ", line)
    return out, sum(c[3] - c[2] for c in changes), sum(c[1] - c[0] for c in changes)


def unified(path: str, old_path: str | None, old: str | None, new: str | None, alike: int | None) -> tuple[int, int, str]:
    """One file's part of a diff: added, removed, text."""
    was = old_path or path
    head = [f"diff --git a/{was} b/{path}"]
    if old is None:
        head.append("new file mode 100644")
    elif new is None:
        head.append("deleted file mode 100644")
    elif old_path:
        head += [f"similarity index {alike}%", f"rename from {old_path}", f"rename to {path}"]
    names = "/dev/null" if old is None else f"a/{was}", "/dev/null" if new is None else f"b/{path}"
    if any("\0" in (t or "")[:SNIFFED] for t in (old, new)):
        return 0, 0, "\n".join([*head, *([f"Binary files {names[0]} and {names[1]} differ"] if old != new else [])]) + "\n"
    body, added, removed = hunks(split_lines(old or ""), split_lines(new or ""))
    if body:
        head += [f"--- {names[0]}", f"+++ {names[1]}"]
    return added, removed, "\n".join([*head, *body]) + "\n"


def renames(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(old_path, path, alike) over (path, text) of both sides: each new file with the vanished one that shares most of its text, as
    percent of the larger one and ALIKE at least, each used once, best pairs first, equal texts before all others. Shares count
    lines as bags by their length.

    All pairs of ALIKE and more are looked at. Where they are many, those of high similarities are walked before lower ones are
    looked for, which the walk's order allows: fewer files are left for them."""
    lines = lambda df: df.select("path", F.explode(F.split("text", "(?<=\n)")).alias("line")).filter("line <> ''").groupBy("path", F.xxhash64("line").alias("line"), F.octet_length("line").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    digest = lambda df, name: df.filter("text <> ''").groupBy(F.sha2("text", 256).alias("sha")).agg(F.sort_array(F.collect_list("path")).alias(name))
    whole = digest(gone, "olds").join(digest(come, "news"), "sha").select(F.explode(F.arrays_zip("olds", "news")).alias("p"))
    exact = whole.select(F.col("p.olds").alias("old_path"), F.col("p.news").alias("path")).filter("old_path IS NOT NULL AND path IS NOT NULL")
    out = materialise(exact.withColumn("alike", F.lit(100)), "exact")
    rest = lambda df, found, c: df.join(found.select(F.col(c).alias("path")), "path", "left_anti")
    a, b = materialise(lines(rest(gone, out, "old_path")), "gone"), materialise(lines(rest(come, out, "path")), "come")
    sides = _bags(a, b, ALIKE)
    if _meetings(sides, ALIKE) > MANY:
        for least in STEPS:
            found = _paired(_bags(a, b, least), least)
            out = out.unionByName(found)
            a, b = materialise(rest(a, found, "old_path"), "gone"), materialise(rest(b, found, "path"), "come")
        sides = _bags(a, b, ALIKE)
    return out.unionByName(_paired(sides, ALIKE))


def _bags(a: DataFrame, b: DataFrame, least: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each side (path, line, size, n): its files (path, bytes, within, bag) that can reach `least` percent by the lines that the
    other side has too; and the lines of their bags (bag, line, size, n, bytes, rest), once for all files that have the same
    such lines. Lines are in one order, those with fewest meetings first; `rest` is the length of a line and of those after it,
    `bytes` that of a bag's smallest file."""
    count = lambda df, c: df.groupBy("line").agg(F.count(F.lit(1)).alias(c))
    both = materialise(count(a, "x").join(count(b, "y"), "line").select("line", (F.col("x") * F.col("y")).alias("meet")), "common")
    weight, known, out = F.col("size") * F.col("n"), F.col("meet").isNotNull(), []
    upto = Window.partitionBy("bag").orderBy("meet", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for df in (a, b):
        names = [F.bit_xor(F.when(known, F.xxhash64(F.lit(k), "line", "n"))) for k in (0, 1)]
        files = df.join(both, "line", "left").groupBy("path").agg(F.sum(weight).alias("bytes"), F.sum(F.when(known, weight)).alias("within"), F.concat_ws("-", *map(F.hex, names)).alias("bag"))
        files = materialise(files.filter(100 * F.col("within") >= least * F.col("bytes")), "files")
        one = files.groupBy("bag").agg(F.min("path").alias("path"), F.min("bytes").alias("bytes"), F.max("within").alias("within"))
        rows = df.join(one, "path").join(both, "line")
        out.append((files, materialise(rows.select("bag", "line", "size", "n", "bytes", (F.col("within") - F.sum(weight).over(upto) + weight).alias("rest")), "bags")))
    return out


def _first(lines: DataFrame, side: str, least: int) -> DataFrame:
    """The lines of each bag that can be the first of those it shares with one of `least` percent: with all after them they
    are long enough. Two such bags have their first shared line among these."""
    rows = lines.filter(100 * F.col("rest") >= least * F.col("bytes"))
    return rows.select("line", F.col("bag").alias(side), F.col("bytes").alias(f"{side}_bytes"), F.col("rest").alias(f"{side}_rest"))


def _meetings(sides: list, least: int) -> int:
    """In how many first lines two bags meet."""
    x, y = (_first(lines, side, least).groupBy("line").agg(F.count(F.lit(1)).alias(side)) for side, (_, lines) in zip(("x", "y"), sides, strict=True))
    return x.join(y, "line").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def _paired(sides: list, least: int) -> DataFrame:
    """The walk over all pairs of files that are alike by `least` percent or more."""
    (olds, a), (news, b) = sides
    enough = lambda x: 100 * x >= least * F.greatest("old_bytes", "new_bytes")
    near = _first(a, "old", least).join(_first(b, "new", least), "line").filter(enough(F.least("old_rest", "new_rest")))
    near = near.groupBy("old", "new").agg(F.max("old_bytes").alias("old_bytes"), F.max("new_bytes").alias("new_bytes"))
    met = near.join(a.select(F.col("bag").alias("old"), "line", "size", "n"), "old").join(b.select(F.col("bag").alias("new"), "line", F.col("n").alias("m")), ["new", "line"])
    shared = met.groupBy("old", "new", "old_bytes", "new_bytes").agg(F.sum(F.col("size") * F.least("n", "m")).alias("shared"))
    pairs = materialise(shared.filter(enough(F.col("shared"))).select("old", "new", "shared"), "alike")
    groups = materialise(_grouped(pairs), "groups")
    files = lambda df, c, kind: df.join(groups.select("root", F.col(c).alias("bag")).distinct(), "bag").select("root", F.lit(kind).alias("kind"), F.col("path").alias("name"), "bag", F.col("bytes").alias("n"))
    rows = groups.select("root", F.lit(0).alias("kind"), F.col("old").alias("name"), F.col("new").alias("bag"), F.col("shared").alias("n"))
    rows = rows.unionByName(files(olds, "old", 1)).unionByName(files(news, "new", 2)).repartition("root").sortWithinPartitions("root", "kind", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, str, int]] = []
        put = lambda: pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int32()))], ["old_path", "path", "alike"])
        root, walk = None, None
        for batch in batches:
            for r, kind, name, bag, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != root:
                    made += walk.pairs() if walk else []
                    root, walk = r, _Walk(least)
                walk.add(kind, name, bag, n)
            if len(made) >= 10_000:
                yield put()
                made = []
        made += walk.pairs() if walk else []
        yield put()

    return materialise(rows.mapInArrow(run, "old_path string, path string, alike int"), "renames")


def _grouped(pairs: DataFrame) -> DataFrame:
    """(root, old, new, shared): pairs of bags with the smallest bag that they are linked to. Most bags have one partner, which has no
    other; the rest is linked by rounds of stars, a few for any number of bags."""
    alone = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("k")).filter("k = 1").select(c)
    lone = pairs.join(alone("old"), "old", "left_semi").join(alone("new"), "new", "left_semi")
    tied = materialise(pairs.join(lone.select("old", "new"), ["old", "new"], "left_anti"), "tied")
    named = lone.withColumn("root", F.concat(F.lit("a"), "old"))
    if not tied.limit(1).count():
        return named
    roots = _roots(tied.select(F.concat(F.lit("b"), "new").alias("u"), F.concat(F.lit("a"), "old").alias("v")))
    least = tied.withColumn("u", F.concat(F.lit("b"), "new")).join(roots, "u").select("old", "new", "shared", F.col("v").alias("root"))
    return named.unionByName(least.select(*named.columns))


def _roots(e: DataFrame) -> DataFrame:
    """(u, v): each node with the smallest it is linked to, over edges (u, v) from larger to smaller ones."""
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    e = materialise(e.distinct(), "edges")
    seen, now = None, mark(e)
    while now != seen:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen, now = now, mark(e)
    return e


class _Files:
    """Files of one bag in the order of their paths: the smallest size of those left, and the first that isn't larger than asked."""

    def __init__(self, files: list[tuple[int, int]]) -> None:
        self.at = [i for i, _ in files]
        self.width = 1 << (len(files) - 1).bit_length()
        self.sizes = [_NONE] * self.width + [n for _, n in files] + [_NONE] * (self.width - len(files))
        for i in range(self.width - 1, 0, -1):
            self.sizes[i] = min(self.sizes[2 * i], self.sizes[2 * i + 1])

    def first(self, most: int) -> int:
        i = 1
        while i < self.width:
            i = 2 * i + (self.sizes[2 * i] > most)
        return i - self.width

    def drop(self, k: int) -> None:
        i = k + self.width
        self.sizes[i] = _NONE
        while i > 1:
            i //= 2
            self.sizes[i] = min(self.sizes[2 * i], self.sizes[2 * i + 1])


class _Walk:
    """Bags that are linked, and their files: pairs of files in the order of what they share (floor of percent, most first), old path, new
    path, each file once. The pairs themselves aren't listed: a vanished file asks its bag's partners for their best."""

    def __init__(self, least: int) -> None:
        self.least, self.partners, self.ids, self.olds, self.news = least, {}, {}, [], []

    def add(self, kind: int, name: str, bag: str, n: int) -> None:
        if kind == 0:
            to, shared = self.partners.setdefault(name, (name, array("q"), array("q")))[1:]
            to.append(self.ids.setdefault(bag, len(self.ids)))
            shared.append(n)
        elif kind == 1:
            self.olds.append((name, self.partners[bag][0], n))
        else:
            self.news.append((name, self.ids[bag], n))

    def pairs(self) -> list[tuple[str, str, int]]:
        lists: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for i, (_, bag, n) in enumerate(self.news):
            lists[bag].append((i, n))
        files = [_Files(x) for x in lists]
        left, head = np.array([f.sizes[1] for f in files]), np.array([f.at[0] for f in files])
        partners = {old: (np.frombuffer(to, np.int64), np.frombuffer(shared, np.int64)) for old, to, shared in self.partners.values()}

        def best(size: int, to: np.ndarray, shared: np.ndarray) -> tuple[int, int, int, int]:
            each = 100 * shared // np.maximum(size, left[to])
            alike = int(each.max())
            if alike < self.least:
                return 0, 0, 0, 0
            tied, common, choice, of, place = to[each == alike], shared[each == alike], len(self.news), 0, 0
            for j in np.argsort(head[tied]).tolist():
                if head[tied[j]] >= choice:
                    break
                k = files[tied[j]].first(100 * int(common[j]) // alike)
                if files[tied[j]].at[k] < choice:
                    choice, of, place = files[tied[j]].at[k], int(tied[j]), k
            return alike, choice, of, place

        out, queue = [], [(-100, i) for i in range(len(self.olds))]
        while queue:
            was, i = heapq.heappop(queue)
            path, bag, size = self.olds[i]
            alike, choice, of, place = best(size, *partners[bag])
            if alike == -was:
                f = files[of]
                f.drop(place)
                left[of], head[of] = f.sizes[1], f.at[f.first(_NONE - 1)] if f.sizes[1] < _NONE else len(self.news)
                out.append((path, self.news[choice][0], alike))
            elif alike:
                heapq.heappush(queue, (-alike, i))
        return out


def first_choices(pairs: DataFrame, left: str, right: str, order: list) -> DataFrame:
    """The pairs that a walk in `order` (which must be total) takes, each side once: in rounds, those that are first for both
    their sides stay and all others of these sides go."""
    left_pairs, taken = materialise(pairs, "pairs"), []
    while left_pairs.limit(1).count():
        place = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(*order))
        ranked = left_pairs.withColumns({"by_left": place(left), "by_right": place(right)})
        taken.append(materialise(ranked.filter("by_left = 1 AND by_right = 1").select(*pairs.columns), "taken"))
        left_pairs = materialise(left_pairs.join(taken[-1].select(left), left, "left_anti").join(taken[-1].select(right), right, "left_anti").select(*pairs.columns), "pairs")
    out = pairs.limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def snapshot_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """SC3, SC4 over (path, text) of two snapshots: a row per changed file: path, old_path (of a rename), status (A, D, M, R), lines
    added and removed, and its part of a unified diff with three lines of context. A text is compared within its row; files
    without a change have no row, a null text is an empty one."""
    side = lambda df, c: df.select("path", F.coalesce("text", F.lit("")).alias(c))
    j = materialise(side(base, "old").join(side(head, "new"), "path", "full").filter(~F.col("old").eqNullSafe(F.col("new"))), "changed")
    moved = materialise(renames(j.filter("new IS NULL").select("path", F.col("old").alias("text")), j.filter("old IS NULL").select("path", F.col("new").alias("text"))), "renames")
    olds = j.filter("new IS NULL").select(F.col("path").alias("old_path"), F.col("old").alias("was"))
    # only renames look for an old text: files without an old path would all meet at its null
    named = j.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").join(moved.join(olds, "old_path"), "path", "left")
    rows = named.select("path", "old_path", F.coalesce("old", "was").alias("old"), "new", "alike")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [unified(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            status = ["R" if o else "A" if x is None else "D" if y is None else "M" for o, x, y in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            cols = [pa.array([m[k] for m in made], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(status, pa.string()), *cols], ["path", "old_path", "status", "added", "removed", "text"])

    return rows.mapInArrow(run, _DIFFS)
