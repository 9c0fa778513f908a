"""Intervals and points of files met by a sweep over sorted bounds, however many a file has.

Bounds are range-partitioned by file and position. An interval that is still open where a partition ends is carried into the
next ones, as far as it reaches: that is as many copies at each end as intervals are open there, whose number is how deep
they nest. Each partition is then swept for itself, so nothing is joined on the file alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.store import materialise

#: Bounds of a partition (about).
AT_ONCE = 200_000


def _swept(events: DataFrame, order: list[str], sweep: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Sweeps `events` (path, pos, upto, kind, ...): `sweep` gets each partition's rows by path, those carried into it first
    (`own` is 0), then by position, kind and `order`. A null `upto` marks a point."""
    events = materialise(events, "events")  # they are counted, sampled and dealt
    n = max(1, -(-events.count() // AT_ONCE))
    dealt = events.filter("path IS NOT NULL AND pos IS NOT NULL").repartitionByRange(n, "path", "pos")
    written = materialise(dealt.withColumns({"part": F.spark_partition_id(), "own": F.lit(1)}), "bounds")
    firsts = written.groupBy("part").agg(F.min(F.struct("path", "pos")).alias("f")).orderBy("part").collect()  # a row per partition
    starts: dict[str, tuple[list[int], list[int]]] = {}
    for r in firsts[1:]:
        at, parts = starts.setdefault(r.f.path, ([], []))
        at.append(r.f.pos)
        parts.append(r.part)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            path, upto, part = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "upto", "part"))
            for i, p in enumerate(path):
                if p in starts and upto[i] is not None:
                    at, later = starts[p]
                    for q in later[int(np.searchsorted(later, part[i], "right")) : int(np.searchsorted(at, upto[i]))]:
                        rows.append(i)
                        parts.append(q)
            out = b.take(pa.array(rows, pa.int64()))
            for name, values in (("part", pa.array(parts, pa.int32())), ("own", pa.array([0] * len(parts), pa.int32()))):
                out = out.set_column(out.schema.get_field_index(name), name, values)
            yield out

    if len(firsts) > 1:
        written = written.unionByName(written.mapInArrow(carried, written.schema))
    keys = [(c, "ascending") for c in ("path", "own", "pos", "kind", *order)]
    return written.groupBy("part").applyInArrow(lambda t: sweep(t.sort_by(keys)), schema)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _events(df: DataFrame, kind: int, pos: str | Column, upto: str | Column | None, **more: Column) -> DataFrame:
    place = lambda c: F.lit(None).cast("long") if c is None else (F.col(c) if isinstance(c, str) else c).cast("long")
    return df.select("path", place(pos).alias("pos"), place(upto).alias("upto"), F.lit(kind).alias("kind"), *[c.alias(n) for n, c in more.items()])


def innermost(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """J17 over (path, symbol_id, start_byte, end_byte) and (path, offset): of the half-open ranges around each offset, the one that
    starts last (the last by id of those). Offsets outside all ranges have no row."""
    offset, kind = points.schema["offset"].dataType.simpleString(), _kind(symbols, "symbol_id")
    none = F.lit(None).cast(kind)
    events = _events(symbols, 0, "start_byte", "end_byte", id=F.col("symbol_id")).unionByName(_events(points.select("path", "offset").distinct(), 1, "offset", None, id=none))

    def sweep(t: pa.Table) -> pa.Table:
        hits, stack, now = [], [], None
        for path, pos, upto, id in zip(*(t.column(c).to_pylist() for c in ("path", "pos", "upto", "id")), strict=True):
            if path != now:
                now, stack = path, []
            if upto is not None:
                stack.append((upto, id))
                continue
            while stack and stack[-1][0] <= pos:
                stack.pop()
            if stack:
                hits.append((path, pos, stack[-1][1]))
        cols = list(zip(*hits, strict=True)) or [(), (), ()]
        return pa.table({"path": pa.array(cols[0], pa.string()), "offset": pa.array(cols[1], pa.int64()), "symbol_id": pa.array(cols[2], t.schema.field("id").type)})

    found = _swept(events, ["id"], sweep, f"path string, offset long, symbol_id {kind}")
    return found.withColumn("offset", F.col("offset").cast(offset))


def parents(symbols: DataFrame) -> DataFrame:
    """J18 over (path, symbol_id, start_byte, end_byte): (symbol_id, parent_id): the innermost other range of the file that contains
    each; of equal ones the last by id. Equal ranges don't contain each other; a symbol without a parent has no row."""
    kind = _kind(symbols, "symbol_id")
    events = _events(symbols, 0, "start_byte", "end_byte", before=-F.col("end_byte").cast("long"), id=F.col("symbol_id"))

    def sweep(t: pa.Table) -> pa.Table:
        ids, ups, stack, now = [], [], [], None
        for path, pos, upto, id, own in zip(*(t.column(c).to_pylist() for c in ("path", "pos", "upto", "id", "own")), strict=True):
            if path != now:
                now, stack = path, []
            while stack and stack[-1][1] < pos:
                stack.pop()
            if own:
                up = next((x for x in reversed(stack) if x[1] >= upto and (x[0] < pos or x[1] > upto)), None)
                if up:
                    ids.append(id)
                    ups.append(up[2])
            stack.append((pos, upto, id))
        return pa.table({"symbol_id": pa.array(ids, t.schema.field("id").type), "parent_id": pa.array(ups, t.schema.field("id").type)})

    return _swept(events, ["before", "id"], sweep, f"symbol_id {kind}, parent_id {kind}")


def overlaps(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """J4 over (path, start_line, end_line, ...) and (path, lo, hi, ...): symbols that share a line with a span, with the columns of
    both. Every pair is found once: where the symbol starts within the span, or the span within the symbol."""
    left, right = [c for c in symbols.columns if c != "path"], [c for c in spans.columns if c != "path"]
    both = lambda a, b: {"a": a, "b": b}
    a, b = F.struct(*left), F.struct(*right)
    no_a, no_b = (F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType) for df, names in ((symbols, left), (spans, right)))
    events = _events(symbols, 0, "start_line", F.col("end_line") + 1, **both(a, no_b)).unionByName(_events(spans, 1, "lo", F.col("hi") + 1, **both(no_a, b)))
    events = events.filter("pos < upto")

    def sweep(t: pa.Table) -> pa.Table:
        lefts, rights, now = [], [], None
        open_: tuple[list, list] = ([], [])
        for i, (path, pos, upto, kind, own) in enumerate(zip(*(t.column(c).to_pylist() for c in ("path", "pos", "upto", "kind", "own")), strict=True)):
            if path != now:
                now, open_ = path, ([], [])
            if own:
                others = open_[1 - kind]
                while others and others[0][0] <= pos:
                    heappop(others)
                for _, j in others:
                    lefts.append(j if kind else i)
                    rights.append(i if kind else j)
            heappush(open_[kind], (upto, i))
        a, b = (t.column(c).combine_chunks().take(pa.array(at, pa.int64())) for c, at in (("a", lefts), ("b", rights)))
        return pa.table({"path": t.column("path").take(pa.array(lefts, pa.int64())), "a": a, "b": b})

    types = {c: events.schema[c].dataType.simpleString() for c in ("a", "b")}
    found = _swept(events, [], sweep, f"path string, a {types['a']}, b {types['b']}")
    return found.select("path", *[F.col("a")[c].alias(c) for c in left], *[F.col("b")[c].alias(c) for c in right])
