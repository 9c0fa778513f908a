"""Exact deduplication by Grace hashing."""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, materialise, ship

#: Bytes of distinct content that a table holds before new contents are spilled (or, before the shuffle, flushed).
TABLE_BYTES = 48 << 20
FAN_OUT = 16


class OpenTable:
    """Open addressing with linear probing; a slot is taken for equal only after its complete content compares equal."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.keys: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, key: bytes) -> tuple[int, int]:
        """(entry or -1, slot)"""
        i, slots, hashes, keys = h & self.mask, self.slots, self.hashes, self.keys
        while (e := slots[i]) >= 0:
            if hashes[e] == h and keys[e] == key:
                return e, i
            i = (i + 1) & self.mask
        return -1, i

    def add(self, slot: int, h: int, key: bytes) -> int:
        self.slots[slot] = e = len(self.keys)
        self.hashes.append(h)
        self.keys.append(key)
        self.bytes += len(key) + 100
        if 2 * len(self.keys) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for e2, h2 in enumerate(self.hashes):
                i = h2 & self.mask
                while self.slots[i] >= 0:
                    i = (i + 1) & self.mask
                self.slots[i] = e2
        return e


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _local(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: copies within a part of the input collapse to one representative, which alone carries the text."""
    seq = TaskContext.get().partitionId() << 36
    names = ["rep", "doc_id", "text_sha256", "body", "max_id", "n"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def flush(t: OpenTable, stats: list[list]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(t.keys), 500):
            part = stats[a : a + 500]
            cols = [[s[0] for s in part], [None] * len(part), [s[3] for s in part], t.keys[a : a + 500], [s[1] for s in part], [s[2] for s in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

    t, stats = OpenTable(), []
    for b in batches:
        ids, reps, shas = b.column(0).to_pylist(), [], []
        for doc, body in zip(ids, b.column(1).to_pylist(), strict=True):
            key = body.lower()  # bytes.lower() touches A-Z only
            sha = hashlib.sha256(key).digest()
            h = int.from_bytes(sha[:8], "little")
            e, slot = t.find(h, key)
            if e < 0:
                t.add(slot, h, key)
                stats.append([seq, doc, 1, sha])
                seq += 1
                e = -1
            else:
                s = stats[e]
                s[1], s[2] = _larger(s[1], doc), s[2] + 1
            reps.append(stats[e][0])
            shas.append(sha)
        none = pa.nulls(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(reps, types[0]), pa.array(ids, types[1]), pa.array(shas, types[2]), *(none.cast(k) for k in types[3:])], names)
        if t.bytes > table_bytes:
            yield from flush(t, stats)
            t, stats = OpenTable(), []
    yield from flush(t, stats)


def _grace(rows: Iterator[tuple], level: int, table_bytes: int, folder: str) -> Iterator[tuple]:
    """(rep, keep_id, group_size) of every row (rep, hash, key, max_id, n).

    Contents meet in an open-addressing table; once it is full, contents that are not in it go to one of FAN_OUT spill
    files by the next bits of their hash, and each file is treated alike one level deeper. Copies of a content never
    need more room than their representative's numbers."""
    t, classes, spills = OpenTable(), [], {}
    for rep, h, key, top, n in rows:
        e, slot = t.find(h, key)
        if e < 0 and t.bytes > table_bytes:
            k = (h >> (20 + 4 * level)) & (FAN_OUT - 1)
            if k not in spills:
                spills[k] = open(os.path.join(folder, f"{level}-{len(os.listdir(folder))}-{k}"), "w+b")  # noqa: SIM115
            pickle.dump((rep, h, key, top, n), spills[k], protocol=5)
            continue
        if e < 0:
            t.add(slot, h, key)
            classes.append([top, n, [rep]])
        else:
            c = classes[e]
            c[0], c[1] = _larger(c[0], top), c[1] + n
            c[2].append(rep)
    del t
    for top, n, reps in classes:
        for rep in reps:
            yield rep, top, n
    del classes
    for f in spills.values():
        f.seek(0)
        yield from _grace(_loads(f), level + 1, table_bytes, folder)
        f.close()
        os.remove(f.name)


def _loads(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _global(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for rep, sha, key, top, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                yield rep, int.from_bytes(sha[:8], "little"), key, top, n

    folder = tempfile.mkdtemp(prefix="grace-")  # of this task alone, gone when it ends
    try:
        out: list[tuple] = []
        for r in _grace(rows(), 0, table_bytes, folder):
            out.append(r)
            if len(out) == 10_000:
                yield _packed(out)
                out = []
        if out:
            yield _packed(out)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rep", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z alone. Copies in one part of the input collapse
    before the shuffle, so a text that fills a third of the table crosses it once per part. The representatives are
    dealt by their digest and classed by recursive Grace partitioning; what each document's class holds comes back by
    a join on its representative, which at most one part's rows share.

    Null and empty texts are one class. A null id counts in group_size and is never the row that stays, unless the
    whole class has null ids (keep_id is then null, and all of them stay). Rows repeated with the same id are all kept if the id
    is. A very long text is compared as a whole. Other columns, whatever their names, are ignored. An empty table gives an empty result."""
    ship(docs.sparkSession)
    schema = "rep long, doc_id long, text_sha256 binary, body binary, max_id long, n long"
    first = materialise(bodies(docs, id_col, text_col).mapInArrow(lambda it: _local(it, table_bytes), schema), "exact")
    reps = first.filter("n is not null").select("rep", "text_sha256", "body", "max_id", "n")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = reps.repartition(parts, "text_sha256").mapInArrow(lambda it: _global(it, table_bytes), "rep long, keep_id long, group_size long")
    rows = first.filter("n is null").select("rep", "doc_id", F.lower(F.hex("text_sha256")).alias("text_sha256"))
    return rows.join(classes, "rep").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
