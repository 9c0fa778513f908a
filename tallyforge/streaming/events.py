"""Structured Streaming over event logs: dedup, windows, poll marks, latest runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """SC: a folder of Parquet files as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """ST1: each event once; state older than the watermark is dropped, so it stays bounded."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str, by: list[str], width: str, delay: str = "1 hour") -> DataFrame:
    """Our extension: counts and sums per window, with late data up to the watermark."""
    if events.isStreaming:
        events = events.withWatermark(ts, delay)
    w = F.window(ts, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("window_start"), *by, "n", "cents")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str) -> DataFrame:
    """ST3 as a session window: a stream that is idle for longer than `gap` ends."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), *by, "n")


def latest_run(events: DataFrame) -> DataFrame:
    """ST2: events of each review's latest run only."""
    last = events.groupBy("review_id").agg(F.max("run_id").alias("run_id"))
    return events.join(last, ["review_id", "run_id"], "left_semi")


#: Events after which a run says no more, and what one says that ends for another reason.
TERMINAL = ("done", "error", "superseded")
REPLACED, IDLE = "a newer review replaced this one", "stream idle timeout"
_DELIVERED = "review_id long, run_id long, seq long, name string, payload string"


def delivered(events: DataFrame) -> DataFrame:
    """ST1, ST2 of a whole log (review_id, run_id, seq, name, payload): what a reader gets who was there from the start: each run's events
    in order, each once, from 1 without a gap to the first terminal one; a run that a newer one replaced before its end closes
    with `superseded`. Of copies of an event the first by name and payload counts."""
    once = events.groupBy("review_id", "run_id", "seq").agg(F.min(F.struct("name", "payload")).alias("e")).select("review_id", "run_id", "seq", "e.*")
    w = Window.partitionBy("review_id", "run_id").orderBy("seq")
    ended = F.coalesce(F.max(F.col("name").isin(*TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = once.filter("seq > 0").withColumns({"place": F.row_number().over(w), "ended": ended}).filter("place = seq AND ended = 0").drop("place", "ended")
    runs = told.groupBy("review_id", "run_id").agg(F.max("seq").alias("last"), F.bool_or(F.col("name").isin(*TERMINAL)).alias("over"))
    newest = events.groupBy("review_id").agg(F.max("run_id").alias("newest"))
    farewell = runs.join(newest, "review_id").filter("NOT over AND run_id < newest")
    return told.unionByName(farewell.select("review_id", "run_id", (F.col("last") + 1).alias("seq"), F.lit("superseded").alias("name"), F.lit(REPLACED).alias("payload")))


def live(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """ST1 to ST3 on a stream of (review_id, run_id, seq, name, payload): the events of `delivered`, as they come: state per review
    holds the run, how far it is told, and events that came before their turn. Copies, however late, and events of replaced
    runs are dropped; a run that says nothing for `idle_ms` ends with an error. History first: the source's files in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, told, over, early = state.get if state.exists else (-1, 0, True, "[]")
        waiting = {x[0]: (x[1], x[2]) for x in json.loads(early)}
        out: list[tuple] = []
        if state.hasTimedOut:
            if not over:
                out.append((key[0], run, told + 1, "error", IDLE))
                over, waiting = True, {}
        else:
            for r in pd.concat(list(batches)).sort_values(["run_id", "seq", "name", "payload"]).itertuples():
                if r.run_id > run:
                    if not over and told:
                        out.append((key[0], run, told + 1, "superseded", REPLACED))
                    run, told, over, waiting = int(r.run_id), 0, False, {}
                if r.run_id == run and r.seq > told and not over:
                    waiting.setdefault(int(r.seq), (r.name, r.payload))
                while not over and told + 1 in waiting:
                    told += 1
                    name, payload = waiting.pop(told)
                    out.append((key[0], run, told, name, payload))
                    over = name in TERMINAL
        state.update((run, told, over, json.dumps([[k, *v] for k, v in ({} if over else waiting).items()])))
        if not over:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["review_id", "run_id", "seq", "name", "payload"])

    return events.groupBy("review_id").applyInPandasWithState(step, _DELIVERED, "run long, told long, over boolean, early string", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Calls that fail in a row until a breaker opens, and milliseconds until it lets one through again.
FAILURES, OPEN_MS = 5, 30_000


def breaker(calls: DataFrame, failures: int = FAILURES, open_ms: int = OPEN_MS) -> DataFrame:
    """ST11 on a stream or a table of (service, at, ok), `at` in milliseconds: (service, at, state, allowed) of each call, in order
    of time. Closed, a breaker opens after `failures` failures in a row; open, it refuses calls for `open_ms`; then it is half
    open: one call goes through, whose outcome closes or opens it. The clock is the calls' own, so a replay gives the same."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, since = state.get if state.exists else (0, -1)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "ok"]).itertuples():
            half = since >= 0 and r.at >= since + open_ms
            now = "half-open" if half else "open" if since >= 0 else "closed"
            allowed = now != "open"
            if allowed:
                failed = 0 if r.ok else failed + 1
                since = -1 if r.ok else int(r.at) if half or failed >= failures else since
            out.append((key[0], int(r.at), now, allowed))
        state.update((failed, since))
        yield pd.DataFrame(out, columns=["service", "at", "state", "allowed"])

    schema = "service string, at long, state string, allowed boolean"
    return calls.groupBy("service").applyInPandasWithState(step, schema, "failed long, since long", "append", GroupStateTimeout.NoTimeout)


def poll_marks(comments: DataFrame) -> DataFrame:
    """ST4, ST5: comments above their thread's mark, the mark held as state. A thread seen first only records it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("id")
        if state.exists:
            (mark,) = state.get
            yield rows[rows["id"] > mark][["number", "id", "author", "body"]]
            state.update((max(mark, int(rows["id"].max())),))
        else:
            state.update((int(rows["id"].max()),))

    out = "number long, id long, author string, body string"
    return comments.groupBy("number").applyInPandasWithState(step, out, "mark long", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, at: str, checkpoint: str, mode: str = "append", until_quiet: bool = True) -> StreamingQuery:
    """SK8, ST10: process what is there, resume where the checkpoint left off, and end. `until_quiet`: batches without data follow,
    which close windows; a stream whose state waits for the clock has no end of these and must do without."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(until_quiet).lower())
    try:
        q = df.writeStream.outputMode(mode).format("parquet").option("path", at).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    q.awaitTermination()
    return q


def ndjson(df: DataFrame) -> DataFrame:
    """SK8: one JSON line per event."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
