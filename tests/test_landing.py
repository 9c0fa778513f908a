"""Lists followed by their links, against a plain walk; polls with ETags over restarts; open threads."""

import json
import random

from tallyforge.sources import commits as C
from tallyforge.sources import landing as L

A = "https://h/x"


def rows(spark, found):
    return spark.createDataFrame([(f, n, b, u, s, k, e, t) for n, (f, b, u, s, k, e, t) in enumerate(found)], L.RESPONSES)


def link(u):
    return f'<{u}>; rel="next", <{A}>; rel="last"' if u else None


def walked(found, fetch, start, limit):
    """As a client does: page after page, the last answer of a URL."""
    by = {(f, u): (s, k, t) for f, _, u, s, k, _, t in found}
    got, url = [], start
    for _ in range(limit):
        s, k, t = by.get((fetch, url), (None, None, None))
        if s is None or not 200 <= s < 300:
            return "broken", None
        got += json.loads(t)
        url = k.split(">")[0][1:] if k and 'rel="next"' in k.split(",")[0] else None
        if not url or not url.startswith("https://h/"):
            return "whole", got
    return "cut", got


def test_follow_is_a_walk(spark):
    r = random.Random(3)
    found, starts = [], []
    for fetch in (1, 2):
        for i in range(40):
            n, url = r.choice([1, 2, 3, 4, 5, 7, 8, 9, 12]), f"https://h/l{i}"
            starts.append((fetch, url))
            for p in range(n):
                at = url if p == 0 else f"https://h/r{i}?page={p}"
                to = f"https://h/r{i}?page={p + 1}" if p + 1 < n else r.choice([None, None, None, "https://other/a", at, "http://h/a", "https://h/gone"])
                body = json.dumps([{"id": 100 * i + p}, {"id": p}][: r.choice([0, 1, 2])])
                if r.random() < 0.1:
                    found.append((fetch, p == 0, at, 502, None, None, "bad gateway"))  # asked again
                found.append((fetch, p == 0, at, 404 if r.random() < 0.05 else 200, link(to), None, body))
    found += [(1, True, None, 200, None, None, "[]"), (1, False, A + "/loose", 200, None, None, "[]")]
    for limit in (1, 5, 20):
        pages = L.follow(rows(spark, found), limit=limit)
        state = {(p.fetch, p.list): p.state for p in pages.collect()}
        got = {}
        for x in sorted(L.items(pages).collect(), key=lambda x: (x.page, x.item_no)):
            got.setdefault((x.fetch, x.list), []).append(json.loads(x.item))
        want = {k: walked(found, *k, limit) for k in starts}
        assert state == {k: w[0] for k, w in want.items()}
        assert got == {k: w[1] for k, w in want.items() if w[1]}
        assert limit != 5 or {w[0] for w in want.values()} == {"whole", "cut", "broken"}


def test_answers_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    found = [(1, p == 0, f"{A}?page={p}" if p else A, 200, link(f"{A}?page={p + 1}") if p < 6 else None, None, f"[{p}]") for p in range(7)]
    got = L.items(L.follow(rows(spark, found).mapInArrow(counted, L.RESPONSES))).collect()
    assert sorted((x.list, x.page, x.item, x.state) for x in got) == [(A, p, str(p), "whole") for p in range(7)]
    assert seen.value == len(found)


def test_odd_answers(spark):
    none = spark.createDataFrame([], L.RESPONSES)
    assert L.follow(none).count() == L.items(L.follow(none)).count() == L.open_threads(none).count() == 0
    found = [(1, True, A, 200, None, None, None), (1, True, A + "1", 200, "", None, "no json"), (1, True, A + "2", 200, None, None, '{"a": 1}'), (1, True, A + "3", None, None, None, "[1]"), (1, True, A + "4", 200, None, None, '["ü", 2]')]
    got = rows(spark, found)
    assert sorted((x.list[len(A) :], x.item) for x in L.items(L.follow(got.unionByName(got))).distinct().collect()) == [("4", "2"), ("4", "ü")]


def land(spark, at, found):
    rows(spark, found).coalesce(1).write.mode("append").json(at)


def test_poll(spark, tmp_path):
    at, tables = str(tmp_path / "land"), C.Tables(spark, str(tmp_path / "t"), L.POLLED)
    run = lambda: L.poll(L.response_stream(spark, at, 1), tables, str(tmp_path / "ck"))
    two = lambda f, e, ids, status=200: [(f, True, A, 200, link(A + "?p=2"), e, json.dumps(ids[:2])), (f, False, A + "?p=2", status, None, None, json.dumps(ids[2:]))]
    items = lambda: [x.item for x in tables.read("items").orderBy("list", "page", "item_no").collect()]
    mark = lambda: [(m.fetch, m.etag) for m in tables.read("marks").collect()]
    land(spark, at, two(1, "a", [1, 2, 3]))
    run()
    assert items() == ["1", "2", "3"] and mark() == [(1, "a")]
    land(spark, at, [(2, True, A, 304, None, "a", None)])
    run()
    land(spark, at, two(3, "a", [9, 9, 9]))  # the same ETag: not new
    run()
    assert items() == ["1", "2", "3"] and mark() == [(1, "a")]
    land(spark, at, two(4, "b", [4, 5, 6], status=500))  # broken: neither items nor mark
    run()
    assert items() == ["1", "2", "3"] and mark() == [(1, "a")]
    land(spark, at, two(5, "b", [4, 5, 6]) + two(6, "c", [7]))  # the newest of a batch
    run()
    run()
    assert items() == ["7"] and mark() == [(6, "c")]


def test_poll_broken_after_whole(spark, tmp_path):
    """The newest whole fetch of a batch counts, and a list that became empty has no items."""
    at, tables = str(tmp_path / "land"), C.Tables(spark, str(tmp_path / "t"), L.POLLED)
    land(spark, at, [(1, True, A, 200, None, "a", "[1]"), (2, True, A, 200, link(A + "?p=2"), "b", "[2]")])
    L.poll(L.response_stream(spark, at), tables, str(tmp_path / "ck"))
    assert [x.item for x in tables.read("items").collect()] == ["1"]
    land(spark, at, [(3, True, A, 200, link(A + "?p=2"), "b", "[2]"), (4, True, A, 200, None, "b", "[]"), (5, True, A, 304, None, "b", None)])
    L.poll(L.response_stream(spark, at), tables, str(tmp_path / "ck"))
    assert tables.read("items").count() == 0 and [m.etag for m in tables.read("marks").collect()] == ["b"]


def test_open_threads(spark):
    thread = lambda i, done, *c: {"id": i, "isResolved": done, "comments": {"nodes": [{"databaseId": x} for x in c]}}
    body = lambda *t: json.dumps({"data": {"repository": {"pullRequest": {"reviewThreads": {"nodes": list(t)}}}}})
    found = [body(thread("a", False, 1), thread("b", True, 2), thread("c", None, 3, None, 0), thread("d", False, 1), None), json.dumps({"data": None}), json.dumps({"errors": [{"message": "m"}]}), None, "x"]
    got = L.open_threads(rows(spark, [(1, True, f"{A}{i}", 200, None, None, b) for i, b in enumerate(found)]))
    assert sorted(tuple(x) for x in got.collect()) == [(A + "0", 1, "d"), (A + "0", 3, "c")]
