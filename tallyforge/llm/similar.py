"""Near copies by the Jaccard similarity of word shingles: pigeonhole blocks of wide SimHash fingerprints name candidates, the whole shingle sets decide."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, materialise, scratch, ship
from tallyforge.llm.graph import components
from tallyforge.llm.simhash import SEED, _settle, shingle_hashes
from tallyforge.llm.tokens import forget

#: Chance that two sets of similarity 0.8 share no block, the share of equal bits expected of them (1 - acos(8 / 9) / pi), and the
#: most bits of a block.
MISS, AGREE, MOST_BITS = 3e-6, 0.8485, 20
#: Bits by which the first CHECKED bits of two fingerprints differ at most: 19.4 are expected at 0.8, more come with a chance of 2e-6.
CHECKED, RADIUS = 128, 38
#: Buckets up to this size are compared all with all; in larger ones, those near to one leader are taken together first.
BRUTE = 2048
_DRAWS = np.random.default_rng(SEED).integers(0, 2**64, (2, 128), np.uint64, endpoint=False)
_MIX, _FACTOR = _DRAWS[0], _DRAWS[1] | np.uint64(1)
#: Words of 64 bits in which a set's shared shingles are told by parity. Any number gives right pairs, more give fewer to compare.
PARITY = 8
_BITS = [f"bits{k}" for k in range(PARITY)]
#: Nodes up to which the list of those whose sets are wanted is broadcast.
BROADCAST_NODES = 2_000_000


def shingle_set(body: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(np.frombuffer(shingle_hashes(body, width), ">u8").astype(np.uint64))


def node_of(s: np.ndarray) -> int:
    """Equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def block_plan(count: int) -> tuple[int, int]:
    """Blocks of a fingerprint and bits of each, for so many documents. Fingerprints that differ in fewer bits than there are blocks agree in one;
    of pairs of similarity 0.8, all but MISS do. A bucket of unrelated ones stays at some two hundred."""
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(count, 2))) - 8))
    return max(-(-CHECKED // bits), math.ceil(math.log(MISS) / math.log(1 - AGREE**bits))), bits


def wide_fingerprint(s: np.ndarray, n: int) -> np.ndarray:
    """The first n bits (at most 8192) of a set's fingerprint: 1 where it is set in over half of its hashes, which are mixed anew for each 64 bits."""
    words = -(-n // 64)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(s), 255):  # eight counters of a byte each hold up to 255
        x = (s[at : at + 255, None] ^ _MIX[:words]) * _FACTOR[:words]
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1).view(np.uint64).sum(axis=0).view(np.uint8)
    return (2 * counts > len(s))[:n]


def block_keys(fp: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """The bucket of each block: its number and its bits."""
    return (fp[: blocks * bits].reshape(blocks, bits) @ (1 << np.arange(bits)) + (np.arange(blocks) << bits)).astype(np.int32)


def _sketches(batches: Iterator[pa.RecordBatch], width: int, blocks: int, bits: int) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        sets = [shingle_set(x, width) for x in b.column(1).to_pylist()]
        made = [wide_fingerprint(s, max(CHECKED, blocks * bits)) for s in sets]
        keys = pa.array([block_keys(f, blocks, bits) for f in made], pa.list_(pa.int32()))
        checked = np.packbits(np.array([f[:CHECKED] for f in made], bool).reshape(len(made), CHECKED), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in checked.T), keys], ["doc_id", "node", "size", "first", "second", "keys"])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= RADIUS


def _large_bucket(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints of a bucket that are near each other, perhaps others: each goes to the first leader near it, leaders
    with followers are taken together, and only those that follow none are compared with all others."""
    left, alone, first, a, b = np.arange(len(f)), [], None, [], []
    while len(left):
        near = _near(f[left], f[left[0]])
        near[0] = True
        took, left = left[near], left[~near]
        if len(took) == 1:
            alone.append(took[0])
            continue
        first = took[0] if first is None else first
        a.append(took)
        b.append(np.full(len(took), first))
    followers = np.concatenate(a) if a else np.zeros(0, np.int64)
    for i in alone:
        near = followers[_near(f[followers], f[i])]
        a.append(near)
        b.append(np.full(len(near), i))
    return (np.concatenate(a), np.concatenate(b)) if a else (followers, followers)


def near_labels(bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
    """For rows sorted by bucket, the first row that each can reach by steps of at most RADIUS bits within its bucket."""
    starts = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1]
    sizes = np.diff(np.r_[starts, len(bucket)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, n in zip(starts[sizes > BRUTE].tolist(), sizes[sizes > BRUTE].tolist(), strict=True):
        x, y = _large_bucket(f[at : at + n])
        a.append(x + at)
        b.append(y + at)
    end, step = np.repeat(np.where(sizes > BRUTE, 0, starts + sizes), sizes), 1
    at = np.nonzero(np.arange(1, len(bucket) + 1) < end)[0]
    while len(at):
        hit = at[_near(f[at], f[at + step])]
        a.append(hit)
        b.append(hit + step)
        step += 1
        at = at[at + step < end[at]]
    return _settle(np.arange(len(bucket)), np.concatenate(a), np.concatenate(b))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, size, first, second) sorted by bucket and node -> (key, node, size): those near each other, by their first node."""
    held, n = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(b)
            n += b.num_rows
            if n < 65_536:
                continue
        t = pa.Table.from_batches(held) if held else None
        if not n:
            continue
        bucket = t.column("bucket").to_numpy()
        cut = n if b is None else int(np.searchsorted(bucket, bucket[-1]))
        if cut:
            f = np.stack([t.column(c).to_numpy()[:cut] for c in ("first", "second")], axis=1).view(np.uint64)
            label = near_labels(bucket[:cut], f)
            at = np.nonzero(np.bincount(label, minlength=cut)[label] > 1)[0]
            node = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[label[at]]), pa.array(node[at]), pa.array(t.column("size").to_numpy()[at])], ["key", "node", "size"])
        held = t.slice(cut).to_batches()
        n -= cut


def near_stars(nodes: DataFrame) -> DataFrame:
    """(key, node, size) of `nodes` (node, size, first, second, keys): nodes that share a block and differ in at most RADIUS of the first
    CHECKED bits, or are joined by steps of such ones in one bucket, have a key in common. A large group costs a row per member and bucket, no pairs."""
    rows = nodes.select(F.explode("keys").alias("bucket"), "node", "size", "first", "second")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(_stars, "key long, node long, size int").distinct()


def prefix_lengths(n: int, least: float) -> tuple[int, int]:
    """Of a set of n shingles in the common order, rarest first: how many it is looked up by, and by how many it is found. Two
    sets at least `least` alike share a shingle that is among the latter of the smaller and among the former of the larger."""
    return n - math.ceil(least * n - 1e-9) + 1, n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, size, root, hashes) -> a row for each shingle."""
    for b in batches:
        for first in range(0, b.num_rows, 100):
            some = b.slice(first, 100)
            sets = [np.frombuffer(raw.as_py(), np.int64) for raw in some.column(3)]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), some.column(0).take(at), some.column(2).take(at)], ["shingle", "node", "root"])


def parity(s: np.ndarray) -> np.ndarray:
    """A bit per slot of hashes: whether an odd number of the set's shingles fall in it. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, size, root, shared: those of its shingles that other roots have too, with their counts) -> a row for each shared
    shingle of the prefix: shingle, place in the order, whether the set is found by it, how many shingles aren't shared, parity."""
    for b in batches:
        keys, places, found, rows, alone, bits = [], [], [], [], [], []
        for i, size in enumerate(b.column(1).to_pylist()):
            shared = b.column(3)[i].values
            n, s = shared.field("n").to_numpy(), shared.field("shingle").to_numpy().view(np.uint64)
            asked, finds = prefix_lengths(size, least)
            order = np.lexsort((s, n))[: max(0, asked - (size - len(s)))]
            keys.append(s[order].view(np.int64))
            places.append(np.arange(len(order), dtype=np.int32) + (size - len(s)))
            found.append(places[-1] < finds)
            rows.append(np.full(len(order), i, np.int64))
            alone.append(size - len(s))
            bits.append(parity(s))
        if rows:
            at = np.concatenate(rows)
            more = [pa.array(np.array(alone, np.int32)[at]), *(pa.array(np.ascontiguousarray(w)) for w in np.array(bits)[at].T)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), pa.array(np.concatenate(found)), *(b.column(i).take(pa.array(at)) for i in range(3)), *more], ["shingle", "place", "finds", "node", "size", "root", "alone", *_BITS])


def _prefix_pairs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of unlike root among `members` (node, size, root) that may be `least` alike: exact by size, prefix, place and parity.

    Shingles of one root alone come first in the order, as no such pair meets in them, then the others by their counts, rarest
    first. Sets that share only a common passage have rarer shingles before it and don't meet in it; of those that do meet (near copies
    of one text that are less than `least` alike do), the shingles that only one of two sets can have tell most. So no bucket is
    compared all with all, and what comes out is little more than the links."""
    held = materialise(members.join(sets, "node").select("node", "size", "root", "hashes"), "members")
    each = materialise(held.mapInArrow(_exploded, "shingle long, node long, root long"), "shingles")
    known = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    known = materialise(known.filter("low != high").select("shingle", "n"), "counts")
    shared = each.join(known, "shingle").groupBy("node").agg(F.collect_list(F.struct("n", "shingle")).alias("shared"))
    rows = held.drop("hashes").join(shared, "node").select("node", "size", "root", "shared")
    rows = rows.mapInArrow(lambda it: _prefixes(it, least), f"shingle long, place int, finds boolean, node long, size int, root long, alone int, {', '.join(f'{c} long' for c in _BITS)}")
    rows = materialise(rows, "prefixes")
    x, y = rows.filter("finds").alias("x"), rows.alias("y")
    need = F.ceil((F.col("x.size") + F.col("y.size")) * F.lit(least / (1 + least)) - F.lit(1e-9))
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")))
    fits = smaller & (F.col("x.root") != F.col("y.root")) & (F.col("x.size") >= F.col("y.size") * F.lit(least) - F.lit(1e-9))
    fits &= F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= need
    unlike = F.col("x.alone") + F.col("y.alone")
    for c in _BITS:
        unlike += F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    fits &= unlike <= F.col("x.size") + F.col("y.size") - 2 * need
    pairs = x.join(y, F.col("x.shingle") == F.col("y.shingle")).filter(fits)
    return materialise(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 100):
            sets = [shingle_set(x, width) for x in b.column(1).slice(at, 100).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both / (len(x) + len(y) - both) >= least)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose sets are at least `least` alike."""
    at = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_hashes"))
    both = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "a_hashes", "b_hashes")
    return materialise(both.mapInArrow(lambda it: _alike(it, least), "a long, b long"), "links")


def _pairs(df: DataFrame, x: str, y: str, least: float) -> DataFrame:
    """Each pair of nodes once, without those that differ too much in size to be alike."""
    node, size = (lambda f, c: f(f"{x}.{c}", f"{y}.{c}")), (lambda f: f(f"{x}.size", f"{y}.size"))
    fits = df.filter(size(F.least) / size(F.greatest) >= least)
    return materialise(fits.select(node(F.least, "node").alias("a"), node(F.greatest, "node").alias("b")).distinct(), "pairs")


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest id reachable by steps of similarity `least` or more).

    Similarity is the Jaccard similarity of the sets of lowercased `width`-word shingles. Their fingerprints meet by pigeonhole
    blocks and are verified by Hamming distance. Two rounds compare the nodes of each star of near fingerprints with one of
    them on their whole sets, so a large group of near copies costs a pair per member and star; only then are the nodes
    of stars that aren't connected yet paired by the shingles of their prefixes, which misses no pair of them.

    Texts of fewer words are one shingle; null and empty texts, and those without a word, are alike. A null id takes part
    and is smallest only where no other id is (component_id is then null). Repeated rows are one node; a very long text's whole
    set is compared. Other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark):
        texts = bodies(docs, id_col, text_col)
        plan = block_plan(docs.count())
        rows = materialise(texts.mapInArrow(lambda it: _sketches(it, width, *plan), "doc_id long, node long, size int, first long, second long, keys array<int>"), "sketches")
        nodes = materialise(rows.filter("size > 0").drop("doc_id").dropDuplicates(["node"]), "nodes")
        open_ = materialise(near_stars(nodes).withColumn("root", F.col("node")), "stars")
        sets = links = roots = None
        for pick in (F.min, F.max, None):
            lead = pick(F.struct("node", "size", "root")) if pick else F.struct(F.mode("root").alias("root"))
            spans = open_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead.alias("lead"))
            spans = materialise(spans.filter("low != high").select("key", "lead"), "spans")
            open_ = materialise(open_.join(spans, "key").select("key", F.struct("node", "size", "root").alias("x"), "lead"), "open")
            if sets is None:
                wanted = materialise(open_.select("x.node").distinct(), "wanted")
                few = wanted.count() <= BROADCAST_NODES
                made = texts.mapInArrow(lambda it: _sets(it, width), "node long, hashes binary")
                sets = materialise(made.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
            apart = open_.filter("x.root != lead.root")
            if pick:
                pairs = _pairs(apart, "x", "lead", least)
            else:
                members = open_.join(apart.select("key").distinct(), "key", "left_semi").select("x.node", "x.size", "x.root").distinct()
                pairs = _prefix_pairs(members, sets, least)
            found = _links(pairs, sets, least)
            links = found if links is None else links.unionByName(found)
            roots = materialise(components(links), "roots")
            back = open_.select("key", "x.node", "x.size").join(roots, "node", "left")
            open_ = materialise(back.select("key", "node", "size", F.coalesce("root", "node").alias("root")), "buckets")
        rooted = materialise(rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "rooted", kept=True)
        ids = materialise(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids", kept=True)
    return rooted.join(ids, "root").select("doc_id", "component_id")
