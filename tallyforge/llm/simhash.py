"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, materialise, ship
from tallyforge.llm.graph import components

SEED = 42
#: Buckets up to this many fingerprints are compared all with all; larger ones are split by further blocks.
BRUTE = 1024
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(body: bytes, width: int) -> bytes:
    """XXH64 of each shingle, big-endian, end to end; of the whole sequence if it has fewer words; nothing without words."""
    words = body.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])


def fingerprints(hashes: list[bytes]) -> np.ndarray:
    """A fingerprint per document: a bit is 1 if it is set in over half of the document's hashes."""
    n = np.array([len(x) // 8 for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.nonzero(n)[0]
    if not len(full):
        return out
    h = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
    size = n[full]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    runs = -(-size // 255)  # eight counters of a byte each hold up to 255
    run_first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    inner = np.arange(runs.sum()) - np.repeat(run_first, runs)
    cuts = np.repeat(first, runs) + 255 * inner
    fp = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _ONES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        for byte in range(8):
            fp |= (2 * counts[:, byte] > size).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = fp
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = fingerprints([shingle_hashes(x, width) for x in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: each is the smallest index reachable."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not ((up := label[label]) == label).all():
            label = up


def bucket_components(f: np.ndarray, most: int) -> np.ndarray:
    """For distinct fingerprints, the smallest index that each can reach by steps of at most `most` bits within `f`.

    Large buckets: all pairs one bit apart are linked by search; then the bits that vary are dealt to most + 1 blocks,
    of which a close pair shares one, and each sub-bucket that isn't one component yet is treated alike."""
    m = len(f)
    label = np.arange(m)
    if m <= BRUTE:
        for at in range(0, m, 256):
            a, b = np.nonzero(np.bitwise_count(f[at : at + 256, None] ^ f[None, :]) <= most)
            label = _settle(label, a + at, b)
        return label
    varies = int(np.bitwise_or.reduce(f ^ f[0]))
    bits = [i for i in range(64) if varies >> i & 1]
    order = np.argsort(f)
    sorted_f = f[order]
    for i in bits:
        at = np.minimum(np.searchsorted(sorted_f, f ^ np.uint64(1 << i)), m - 1)
        hit = np.nonzero(sorted_f[at] == f ^ np.uint64(1 << i))[0]
        label = _settle(label, hit, order[at[hit]])
    for k in range(most + 1):
        mask = np.uint64(sum(1 << i for i in bits[k :: most + 1]))
        by = np.argsort(f & mask, kind="stable")
        cuts = np.nonzero(np.diff((f & mask)[by]))[0] + 1
        for part in np.split(by, cuts):
            if len(part) > 1 and (label[part] != label[part[0]]).any():
                label = _settle(label, part, part[bucket_components(f[part], most)])
    return label


def _bucket_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (combo, key, fp) sorted by bucket -> a spanning forest of each bucket's links."""

    def links(combo: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.nonzero((np.diff(combo) != 0) | (np.diff(key) != 0))[0] + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
        found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for s, e in zip(*((x[last - first > 1]).tolist() for x in (first, last)), strict=True):
            f = fp[s:e]
            root = bucket_components(f, most)
            other = np.nonzero(root != np.arange(len(f)))[0]
            found_a.append(f[other])
            found_b.append(f[root[other]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple] = []
    for x in batches:
        if not x.num_rows:
            continue
        now = (x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_numpy().view(np.uint64))
        if held and (held[0][0][0], held[0][1][0]) == (now[0][-1], now[1][-1]):
            held.append(now)  # one bucket so far
            continue
        cols = [np.concatenate(c) for c in zip(*held, now, strict=True)]
        ends = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[0]
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield links(*(c[:cut] for c in cols))
        held = [tuple(c[cut:] for c in cols)]
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held, strict=True)))


def block_masks(count: int, most: int) -> list[int]:
    """Masks of the block combinations: fingerprints within `most` bits agree under at least one.

    With `k` blocks, k - most of them agree. k is the fewest from most + 2 on whose k - most blocks have two bits more
    than it takes to count the fingerprints, so a bucket of unrelated fingerprints stays small at any size."""
    k = most + 2
    while k < 16 and 64 * (k - most) / k < math.log2(max(count, 2)) + 2:
        k += 1
    edges = [round(64 * i / k) for i in range(k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, k - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, most: int) -> DataFrame:
    """(a, b): links whose transitive closure is that of all pairs of distinct `fp` within `most` bits."""
    masks = block_masks(nodes.count(), most)
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select(F.col("k.combo").alias("combo"), F.col("k.key").alias("key"), "fp")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "combo", "key").sortWithinPartitions("combo", "key", "fp")
    return dealt.mapInArrow(lambda it: _bucket_links(it, most), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Equal fingerprints are one node, so copies are never paired; distinct ones meet in every block combination they
    share, where a bucket yields a spanning forest of its verified links, never all pairs.

    Null and empty texts, and those without a word, have fingerprint zero and link like any other. A null id takes part
    and is smallest only where no other id is (component_id is then null). Repeated rows share a node. A very long text
    is read whole. Other columns, whatever their names, are ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    rows = materialise(bodies(docs, id_col, text_col).mapInArrow(lambda it: _fingerprint(it, width), "doc_id long, fp long"), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes, most)).withColumnRenamed("node", "fp")
    rooted = materialise(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = materialise(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
