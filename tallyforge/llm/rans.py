"""Token-id files coded by static range asymmetric numeral systems.

A shard holds the ids of a range of documents. One frequency table, shared by all of its blocks, is at its front; each
block of BLOCK ids has LANES interleaved coders and starts anew, so its directory entry (place of its words, the states
of its lanes, a checksum) is a checkpoint from which it can be decoded alone. Blocks are decoded side by side."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, materialise, shared_dir, ship
from tallyforge.llm.tokens import whole_texts

MAGIC = b"TFRANS1\n"
BLOCK, LANES = 1 << 14, 32
TOGETHER = 256  # blocks that are coded side by side
#: Ids of a shard (a little more: the last document is whole), and blocks that one task decodes from a checkpoint on.
SHARD_IDS, GROUP = 1 << 23, 128
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Whole frequencies of at least 1 that sum to 1 << bits, near in proportion to counts."""
    f = np.maximum(1, (counts.astype(np.float64) * ((1 << bits) / counts.sum())).astype(np.int64))
    over = int(f.sum()) - (1 << bits)
    order = np.argsort(-f, kind="stable")
    if over < 0:
        f[order[0]] -= over
    while over > 0:
        for i in order:
            cut = min(over, max(1, int(f[i]) >> 4), int(f[i]) - 1)
            f[i] -= cut
            over -= cut
            if not over:
                break
    return f


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lanes that move a word: row, rank within the row; and how many each row has."""
    rows, _ = np.nonzero(mask)
    count = mask.sum(1)
    return rows, np.arange(len(rows)) - (np.cumsum(count) - count)[rows], count


def encode(ids: np.ndarray) -> dict[str, np.ndarray]:
    """Sections of a shard from its ids."""
    if not len(ids):
        z = np.zeros(0, np.uint32)
        return {"alphabet": z, "freq": z, "crc": z, "begin": np.zeros(1, np.int64), "state": np.zeros((0, LANES), np.uint64), "words": z}
    every = np.bincount(ids)
    alphabet = np.nonzero(every)[0]
    counts, place = every[alphabet], np.zeros(len(every), np.int32)
    place[alphabet] = np.arange(len(alphabet))
    sym = place[ids]
    bits = max(14, int(len(alphabet) - 1).bit_length() + 3)
    f = frequencies(counts, bits)
    freq, cum = f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)
    blocks = -(-len(sym) // BLOCK)
    padded = np.full(blocks * BLOCK, counts.argmax(), np.int64)
    padded[: len(sym)] = sym
    padded = padded.reshape(blocks, BLOCK // LANES, LANES)
    limit, shift = np.uint64(63 - bits), np.uint64(bits)
    states, words, sizes = [], [], []
    for at in range(0, blocks, TOGETHER):
        part = padded[at : at + TOGETHER]
        x = np.full((len(part), LANES), LOW)
        out = np.zeros((len(part), BLOCK), np.uint32)
        end = np.full(len(part), BLOCK)
        for t in range(BLOCK // LANES - 1, -1, -1):
            s = part[:, t]
            fs_, cs = freq[s], cum[s]
            full = x >= (fs_ << limit)
            rows, rank, count = _places(full)
            if len(rows):
                end -= count
                out[rows, end[rows] + rank] = x[full].astype(np.uint32)  # the low half
                x[full] >>= _32
            q = x // fs_
            x = (q << shift) + (x - q * fs_) + cs
        states.append(x)
        sizes.append(BLOCK - end)
        words += [out[i, e:] for i, e in enumerate(end)]
    crc = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4")) for i in range(blocks)]
    begin = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return {"alphabet": alphabet.astype(np.uint32), "freq": f.astype(np.uint32), "crc": np.array(crc, np.uint32), "begin": begin, "state": np.concatenate(states), "words": np.concatenate(words)}


def decode(sections: dict[str, np.ndarray], n: int, first: int = 0, last: int | None = None, words_at: int = 0) -> np.ndarray:
    """Ids of the blocks from `first` up to `last` (all), each checked against its checksum; `words_at`: the place of the
    first of the words that are there."""
    blocks = len(sections["crc"])
    last = blocks if last is None else last
    if first >= last:
        return np.zeros(0, np.uint32)
    f = sections["freq"].astype(np.int64)
    bits = int(f.sum()).bit_length() - 1
    freq, cum = f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)
    of_slot = np.repeat(np.arange(len(f), dtype=np.int32), f)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    words = sections["words"]
    out = []
    for at in range(first, last, TOGETHER):
        to = min(last, at + TOGETHER)
        x, place = sections["state"][at:to].copy(), sections["begin"][at:to].copy()
        got = np.empty((to - at, BLOCK // LANES, LANES), np.int32)
        for t in range(BLOCK // LANES):
            slot = x & mask
            got[:, t] = s = of_slot[slot]
            x = freq[s] * (x >> shift) + slot - cum[s]
            low = x < LOW
            rows, rank, count = _places(low)
            if len(rows):
                take = place[rows] + rank - words_at
                if take.max() >= len(words) or take.min() < 0:
                    raise ValueError("a block does not end where it should")
                x[low] = (x[low] << _32) | words[take]
                place += count
        if (place != sections["begin"][at + 1 : to + 1]).any() or (x != LOW).any():
            raise ValueError("a block does not end where it should")
        out.append(got.reshape(-1))
    ids = sections["alphabet"][np.concatenate(out)][: n - first * BLOCK]
    for i in range(first, last):
        if zlib.crc32(ids[(i - first) * BLOCK : (i - first + 1) * BLOCK].astype("<u4")) != sections["crc"][i]:
            raise ValueError(f"block {i} does not match its checksum")
    return ids


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    parts = encode(ids) | {"doc_id": np.array([x or 0 for x in doc_ids], np.int64), "null": np.array([x is None for x in doc_ids], np.uint8), "length": np.array(lengths, np.int64)}
    body, sections = [], {}
    at = 0
    for k, v in parts.items():
        raw = v.astype(v.dtype.newbyteorder("<")).tobytes()
        raw = raw if k == "words" else zlib.compress(raw, 6)
        sections[k] = [at, len(raw), v.dtype.newbyteorder("<").str]
        at += len(raw)
        body.append(raw)
    head = json.dumps({"n": len(ids), "block": BLOCK, "lanes": LANES, "sections": sections}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


def _header(f: BinaryIO) -> tuple[dict, int]:
    """A shard's header, and where its sections start."""
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a shard of token ids")
    (size,) = struct.unpack("<I", f.read(4))
    head = json.loads(f.read(size))
    if (head["block"], head["lanes"]) != (BLOCK, LANES):
        raise ValueError("a shard of another layout")
    return head, len(MAGIC) + 4 + size


def _section(f: BinaryIO, head: dict, base: int, k: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """A section; of the words, which aren't deflated, also a part alone."""
    at, n, dtype = head["sections"][k]
    if k == "words":
        size = np.dtype(dtype).itemsize
        at, n = at + first * size, n - first * size if last is None else (last - first) * size
    f.seek(base + at)
    raw = f.read(n)
    return np.frombuffer(raw if k == "words" else zlib.decompress(raw), dtype)


def unpack_shard(raw: bytes) -> tuple[int, dict[str, np.ndarray]]:
    f = io.BytesIO(raw)
    head, base = _header(f)
    parts = {k: _section(f, head, base, k) for k in head["sections"]}
    parts["state"] = parts["state"].reshape(-1, LANES)
    return head["n"], parts


def _write(batches: Iterator[pa.RecordBatch], at: str, path: str, words: bool, end_id: int) -> Iterator[pa.RecordBatch]:
    tok = whole_texts(path, words)
    end = np.array([end_id], tok.dtype).tobytes()
    store, folder = fs.FileSystem.from_uri(at)
    doc_ids: list[int | None] = []
    lengths: list[int] = []
    ids: list[bytes] = []
    seq = held = 0

    def flush() -> pa.RecordBatch:
        shard = (TaskContext.get().partitionId() << 24) + seq
        name = f"shard-{shard:014d}-{uuid.uuid4().hex[:8]}.rans"  # an attempt that fails leaves a name that no manifest has
        raw = pack_shard(doc_ids, lengths, np.frombuffer(b"".join(ids), tok.dtype))
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(raw)
        row = [[shard], [f"{at}/{name}"], [len(doc_ids)], [held], [-(-held // BLOCK)], [len(raw)]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["shard", "path", "n_docs", "n_tokens", "n_blocks", "n_bytes"])

    for b in batches:
        for doc, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            one = tok.encode(body.as_py()) + end
            doc_ids.append(doc)
            ids.append(one)
            lengths.append(len(one) // tok.dtype.itemsize)
            held += lengths[-1]
            if held >= SHARD_IDS:
                yield flush()
                doc_ids, lengths, ids, held, seq = [], [], [], 0, seq + 1
    if doc_ids:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that start in GROUP blocks of a shard: only these blocks, and those into which the last document reaches,
    are read and decoded, from their checkpoint on."""
    for b in batches:
        for path, start, first in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            store, p = fs.FileSystem.from_uri(path)
            with store.open_input_file(p) as f:
                head, base = _header(f)
                parts = {k: _section(f, head, base, k) for k in head["sections"] if k != "words"}
                parts["state"] = parts["state"].reshape(-1, LANES)
                ends = np.cumsum(parts["length"])
                begins = ends - parts["length"]
                i, j = np.searchsorted(begins, [first * BLOCK, (first + GROUP) * BLOCK])
                if i == j:
                    continue
                last = -(-int(ends[j - 1]) // BLOCK)
                at = int(parts["begin"][first])
                parts["words"] = _section(f, head, base, "words", at, int(parts["begin"][last]))
            ids = decode(parts, head["n"], first, last, at).astype("<u4")
            view, zero = memoryview(ids), first * BLOCK
            crc = [zlib.crc32(view[s - zero : e - zero]) for s, e in zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True)]
            doc = pa.array(parts["doc_id"][i:j], pa.int64(), mask=parts["null"][i:j].astype(bool))
            yield pa.RecordBatch.from_arrays([doc, pa.array(begins[i:j] + start), pa.array(parts["length"][i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, path: str, words: bool, end_id: int, at: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, `end_id` after each, into shards in ascending id order under `at` (a folder all executors share).

    Returns the manifest: shard, path, n_docs, n_tokens, n_blocks, n_bytes, start (ids in earlier shards). One shuffle deals
    the texts by ranges of ids, those of one id by their place in the input, so that no id is hot; a task ends a shard at
    SHARD_IDS ids. Null texts are empty; null ids come first; rows that repeat an id are written one after the other; a very
    long text stays in one shard; other columns are ignored; an empty table gives no shard."""
    spark = docs.sparkSession
    ship(spark)
    at = at or shared_dir(spark, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bodies(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    schema = "shard long, path string, n_docs long, n_tokens long, n_blocks long, n_bytes long"
    manifest = materialise(dealt.mapInArrow(lambda it: _write(it, at, path, words, end_id), schema), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return materialise(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Decode the shards of a manifest, GROUP blocks at a time: doc_id, start, n_tokens, ids_crc32 of each document."""
    groups = manifest.select("path", "start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 1, F.lit(0)), F.lit(GROUP))).alias("first"))
    n = max(1, groups.count())
    return groups.repartition(n, "path", "first").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
