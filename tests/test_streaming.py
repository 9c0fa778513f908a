"""Streams over folders of files, run to their end and resumed."""

import time
from datetime import datetime

import pytest

from tallyforge.sources import commits as C
from tallyforge.streaming import events as S


def write(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def test_dedup_and_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "review_id long, seq long, ts timestamp, value double"
    t = datetime(2024, 1, 1, 12)
    write(spark, [(1, 1, t, 1.0), (1, 2, t, 2.0), (1, 1, t, 1.0)], schema, src)
    stream = lambda: S.deduplicated(S.event_stream(spark, src, schema), ["review_id", "seq"], "ts")
    S.run_available(stream(), out, ck)
    assert spark.read.parquet(out).count() == 2
    write(spark, [(1, 2, t, 2.0), (1, 3, t, 3.0)], schema, src)
    S.run_available(stream(), out, ck)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windows_with_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "ts timestamp, kind string, value double"
    rows = [(datetime(2024, 1, 1, h, 30), "a", 1.5) for h in (0, 0, 1, 5, 9)]
    write(spark, rows, schema, src)
    S.run_available(S.tumbling(S.event_stream(spark, src, schema), "ts", ["kind"], "1 hour"), out, ck)
    got = {r.window_start.hour: (r.n, r.cents) for r in spark.read.parquet(out).collect()}
    assert got[0] == (2, 300) and got[5] == (1, 150) and 9 not in got


def test_poll_marks(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "number long, id long, author string, body string"
    write(spark, [(1, 5, "a", "x"), (1, 7, "a", "y")], schema, src)
    S.run_available(S.poll_marks(S.event_stream(spark, src, schema)), out, ck)
    write(spark, [(1, 6, "b", "old"), (1, 8, "b", "new"), (2, 1, "c", "first sight")], schema, src)
    S.run_available(S.poll_marks(S.event_stream(spark, src, schema)), out, ck)
    assert [r.id for r in spark.read.parquet(out).collect()] == [8]


EVENTS = "review_id long, run_id long, seq long, name string, payload string"


def test_live_equals_delivered(spark, tmp_path):
    """Events out of order and twice, a replaced run, a restart between two files, a copy long after."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    first = [(1, 1, 2, "b", "x"), (1, 1, 1, "a", "x"), (1, 1, 4, "d", "x"), (2, 1, 1, "a", "y"), (2, 1, 2, "done", "y"), (2, 1, 3, "late", "y"), (3, 1, 1, "a", "z")]
    second = [(1, 1, 2, "b", "x"), (1, 1, 3, "c", "x"), (2, 1, 1, "a", "y"), (3, 2, 1, "a2", "z"), (3, 1, 2, "b", "z"), (3, 2, 2, "error", "z"), (4, 1, 2, "gap", None)]
    third = [(1, 1, 1, "a", "x"), (3, 1, 1, "a", "z"), (3, 2, 1, "a2", "z"), (5, 7, 1, "done", None)]
    for rows in (first, second, third):
        write(spark, rows, EVENTS, src)
        S.run_available(S.live(S.event_stream(spark, src, EVENTS, 1)), out, ck, until_quiet=False)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=key)
    whole = spark.createDataFrame(first + second + third, EVENTS)
    assert got == sorted(map(tuple, S.delivered(whole).collect()), key=key) and len(got) == 12
    assert [r[3] for r in got if r[:2] == (3, 1)] == ["a", "b", "superseded"] and not [r for r in got if r[0] == 4]


def test_idle_end(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    write(spark, [(1, 1, 1, "a", "x"), (2, 1, 1, "done", "y")], EVENTS, src)
    q = S.live(S.event_stream(spark, src, EVENTS), 1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not (q.lastProgress and spark.read.schema(EVENTS).parquet(out).filter("name = 'error'").count()):
            time.sleep(1)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 1, 1, "a", "x"), (1, 1, 2, "error", S.IDLE), (2, 1, 1, "done", "y")]


def test_breaker(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "service string, at long, ok boolean"
    calls = [("s", t, False) for t in range(3)] + [("s", 50, True), ("s", 101, True), ("s", 103, False)]
    later = [("s", 104, False), ("s", 105, False), ("s", 206, False), ("s", 207, True), ("s", 400, True), ("t", 5, False)]
    for rows in (calls, later):
        write(spark, rows, schema, src)
        S.run_available(S.breaker(S.event_stream(spark, src, schema, 1), 3, 100), out, ck)
    got = [(r.at, r.state, r.allowed) for r in spark.read.parquet(out).filter("service = 's'").orderBy("at").collect()]
    assert got == [(0, "closed", True), (1, "closed", True), (2, "closed", True), (50, "open", False), (101, "open", False), (103, "half-open", True), (104, "open", False), (105, "open", False), (206, "half-open", True), (207, "open", False), (400, "half-open", True)]


def tables(spark, at):
    return C.Tables(spark, f"file://{at}", {"reviews": "review_id long, status string, created_at long", "findings": "review_id long, n int"})


def reviews(spark, rows):
    return spark.createDataFrame(rows, "review_id long, status string, created_at long")


def test_commits(spark, tmp_path):
    t = tables(spark, tmp_path / "t")
    f = lambda rows: spark.createDataFrame(rows, "review_id long, n int")
    assert t.read("reviews").collect() == [] and t.state()["number"] == 0
    assert C.save_reviews(t, reviews(spark, [(1, "a", 10), (2, "a", 10)]), f([(1, 1), (1, 2), (2, 1)])) == 1
    before = t.state()
    assert C.save_reviews(t, reviews(spark, [(1, "b", 20), (3, "b", 20)]), f([(1, 9)])) == 2
    assert sorted(map(tuple, t.read("reviews").collect())) == [(1, "b", 10), (2, "a", 10), (3, "b", 20)]
    assert sorted(map(tuple, t.read("findings").collect())) == [(1, 9), (2, 1)] and t.read("findings", before).count() == 3
    assert [tuple(r) for r in C.history(t, "findings").orderBy("number").collect()] == [(1, 3), (2, 2)]


def test_two_writers(spark, tmp_path):
    """One writer loses the number, reads anew and keeps what the other wrote."""
    t, asked = tables(spark, tmp_path / "t"), []

    def slow(now):
        asked.append(now["reviews"].count())
        if len(asked) == 1:
            tables(spark, tmp_path / "t").commit(lambda now: {"reviews": reviews(spark, [(1, "other", 1)])})
        return {"reviews": C.upserted(now["reviews"], reviews(spark, [(2, "slow", 2)]), "review_id")}

    assert t.commit(slow) == 2 and asked == [0, 1]
    assert sorted(map(tuple, t.read("reviews").collect())) == [(1, "other", 1), (2, "slow", 2)]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_killed_writer(spark, tmp_path):
    """A writer that dies over its data or its manifest leaves the last state as it was."""
    t = tables(spark, tmp_path / "t")
    t.commit(lambda now: {"reviews": reviews(spark, [(1, "a", 1)])})

    def dies(now):
        reviews(spark, [(9, "x", 9)]).write.parquet(f"file://{tmp_path}/t/data/dead/reviews")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        t.commit(dies)
    (tmp_path / "t" / "manifests" / "000000000002.json").write_text('{"tables": {"rev')
    assert [r.status for r in t.read("reviews").collect()] == ["a"]
    assert t.commit(lambda now: {"reviews": C.upserted(now["reviews"], reviews(spark, [(2, "b", 2)]), "review_id")}) == 3
    assert t.read("reviews").count() == 2 and t.vacuum(1) == 2 and t.read("reviews").count() == 2


def test_batches_once(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    t = tables(spark, tmp_path / "t")
    write(spark, [(1, 5)], "review_id long, n int", src)
    add = lambda df, now: {"findings": now["findings"].unionByName(df.select("review_id", "n"))}
    stream = lambda: S.event_stream(spark, src, "review_id long, n int", 1)
    C.commit_batches(stream(), t, ck, "w", add)
    (tmp_path / "ck" / "commits" / "0").unlink()  # as after a crash between the commit and the stream's own mark
    (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)
    write(spark, [(1, 6)], "review_id long, n int", src)
    C.commit_batches(stream(), t, ck, "w", add)
    assert sorted(r.n for r in t.read("findings").collect()) == [5, 6] and t.state()["batches"] == {"w": 1}
