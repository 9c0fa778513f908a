"""Search for many literals at once: Aho-Corasick automata over shards of the patterns, each read by every task in one pass."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.store import materialise

#: Characters of the patterns of one shard (about): an automaton has up to a node of some 100 bytes for each.
SHARD_CHARS = 1_000_000
#: Characters of all texts up to which they go to every shard at once.
FEW_CHARS = 20_000_000
#: Characters of lines that a task holds before it hands them on.
HELD_CHARS = 16_000_000

_built: dict[int, ahocorasick.Automaton] = {}


def automaton(patterns: list[str], key: int | None = None) -> ahocorasick.Automaton:
    """The automaton of distinct patterns without the empty one; the last one asked for by key is kept for the worker's next task."""
    if key is None or key not in _built:
        made = ahocorasick.Automaton()
        for p in patterns:
            if p:
                made.add_word(p, p)
        made.make_automaton()
        _built.clear()
        if key is None:
            return made
        _built[key] = made
    return _built[key]


Search = Callable[[str], Iterator[tuple]]


def _each(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[tuple]:
    """(key, *hit) of every text."""
    for b in batches:
        for key, text in zip(b.column(0), b.column(1), strict=True):
            for hit in search(text.as_py()) if text.is_valid else ():
                yield key.as_py(), *hit


def _searched(texts: DataFrame, patterns: DataFrame, find: Callable[[str, Iterable[tuple[int, str]], bool], Iterator[tuple]], found: list[tuple[str, str]], fold: Callable[[Iterator[pa.RecordBatch], Search], Iterator[tuple]] = _each) -> DataFrame:
    """Rows of `texts` (key, text) against `patterns` (pattern), shard by shard: key and what `find` gives for each text, as `found` names
    it. `fold` goes through a task's texts and may leave out hits.

    Texts are read once per shard; each shard is broadcast after a check of its size, and beyond one shard each result is
    written before the next shard is handed out; texts of up to FEW_CHARS go to the shards instead, all in one job. Hits leave a task in batches of bounded size."""
    spark = texts.sparkSession
    distinct = patterns.select("pattern").filter("pattern IS NOT NULL").distinct()
    chars = distinct.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0
    n = -(-chars // SHARD_CHARS)
    kind = texts.schema["key"].dataType
    schema = ", ".join([f"key {kind.simpleString()}", *(f"{c} {t}" for c, t in found)])
    types = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch], shard: Broadcast) -> Iterator[pa.RecordBatch]:
        words = shard.value
        machine, empty = automaton(words, id(words)), "" in words
        key: list[pa.DataType] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                key[:] = [b.schema.field(0).type]
                yield b

        def batch() -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [key[0], *(types[t] for _, t in found)], strict=True)]
            return pa.RecordBatch.from_arrays(made, ["key", *(c for c, _ in found)])

        rows, size = [], 0
        for hit in fold(typed(), lambda text: find(text, machine.iter(text) if len(machine) else (), empty)):
            rows.append(hit)
            size += 64 + sum(len(x) for x in hit if isinstance(x, str))
            if size > HELD_CHARS:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    if n > 1 and fold is _each and (texts.agg(F.sum(F.length("text") + 16)).first()[0] or 0) <= FEW_CHARS:

        def cell(words: pa.Table, asked: pa.Table) -> pa.Table:
            held = words.column("pattern").to_pylist()
            machine, empty = automaton(held), "" in held
            rows = list(_each(iter(asked.to_batches()), lambda text: find(text, machine.iter(text) if len(machine) else (), empty)))
            cols = zip(*rows, strict=True) if rows else [[]] * (1 + len(found))
            return pa.table([pa.array(c, t) for c, t in zip(cols, [asked.schema.field(0).type, *(types[t] for _, t in found)], strict=True)], names=["key", *(c for c, _ in found)])

        dealt = distinct.select("pattern", F.pmod(F.xxhash64("pattern"), F.lit(n)).cast("int").alias("shard")).repartition(n, "shard")
        every = texts.select("key", "text", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard")).repartition(n, "shard")
        return dealt.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(cell, schema)
    parts = []
    for i in range(n):
        words = [r.pattern for r in distinct.filter(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).collect()]
        shard = spark.sparkContext.broadcast(words)
        hits = texts.select("key", "text").mapInArrow(lambda it, shard=shard: run(it, shard), schema)
        parts.append(materialise(hits, f"patterns-{i}") if n > 1 else hits)
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, pattern): the patterns that each text holds, once each, as substrings without any word boundary. Any number of
    patterns of any length; the empty one is in every text that isn't null."""

    def find(text: str, ends_of: Iterable[tuple[int, str]], empty: bool) -> Iterator[tuple]:
        yield from ((p,) for p in {p for _, p in ends_of} | ({""} if empty else set()))

    return _searched(texts, patterns, find, [("pattern", "string")])


def _lines(text: str, ends_of: Iterable[tuple[int, str]], empty: bool, most: int) -> Iterator[tuple[str, int, int, int]]:
    """(pattern, line_no, begin, end) of the first `most` lines that hold each pattern."""
    ends = [i for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] != len(text) - 1:
        ends.append(len(text))
    found: dict[str, list[int]] = {"": list(range(1, min(most, len(ends)) + 1))} if empty else {}
    for end, p in ends_of:
        lines, no = found.setdefault(p, []), bisect_left(ends, end) + 1
        if len(lines) < most and (not lines or lines[-1] != no) and "\n" not in p:
            lines.append(no)
    for p, lines in found.items():
        for no in lines:
            yield p, no, ends[no - 2] + 1 if no > 1 else 0, ends[no - 1]


def line_hits(texts: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """(key, pattern, line_no, line): the first `most` lines of each text that hold each pattern; a line counts once per pattern,
    and a last line end makes no further line."""

    def find(text: str, ends_of: Iterable[tuple[int, str]], empty: bool) -> Iterator[tuple]:
        return ((p, no, text[a:z]) for p, no, a, z in _lines(text, ends_of, empty, most))

    return _searched(texts, patterns, find, [("pattern", "string"), ("line_no", "int"), ("line", "string")])


def first_hits(texts: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """(key, pattern, line_no, line) that has the first `most` rows of each pattern by key and line, and some more: a task holds
    no more than those of what it has read, and hands them on when they are many."""

    def find(text: str, ends_of: Iterable[tuple[int, str]], empty: bool) -> Iterator[tuple]:
        return ((p, no, a, z, text) for p, no, a, z in _lines(text, ends_of, empty, most))

    def fold(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[tuple]:
        held: dict[str, list[tuple]] = {}
        size = 0
        for n, (key, p, no, a, z, text) in enumerate(_each(batches, search)):
            kept, place = held.setdefault(p, []), (key is not None, key, no)
            if len(kept) == most and kept[-1][:3] <= place:
                continue
            insort(kept, (*place, n, text[a:z]))
            size += 64 + z - a
            if len(kept) > most:
                size -= 64 + len(kept.pop()[4])
            if size > HELD_CHARS:
                yield from ((x[1], p, x[2], x[4]) for p, kept in held.items() for x in kept)
                held, size = {}, 0
        yield from ((x[1], p, x[2], x[4]) for p, kept in held.items() for x in kept)

    return _searched(texts, patterns, find, [("pattern", "string"), ("line_no", "int"), ("line", "string")], fold)
