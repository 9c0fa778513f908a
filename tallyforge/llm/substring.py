"""Repeated passages by De Bruijn graphs: k-mers of words are edges, repeated nonbranching paths are compacted, and
their source coordinates verified.

Documents are dealt to batches. Three joins between batches and hash ranges of the graph follow:

1. Minimisers. Of the grams in a k-mer the smallest by hash is its minimiser, so equal k-mers share it. Each batch sends
   its distinct minimisers to their hash ranges and gets back those that another document has too.
2. Edges. Only k-mers under such minimisers are edges that may repeat; each batch sends its distinct ones, with the
   smallest (document, position) that it has, and gets back the repeated ones with their first source in the corpus.
3. Paths. The source of an edge, its first occurrence, is told where it is; between two edges lies a node, a (k-1)-mer.
   Runs of edges that follow each other at their source are split by a Spark join at branching nodes (those that more
   than one edge enters or leaves), and the pieces that meet in a node without branches, in whatever documents, are
   compacted to one path by joins on the node.
4. Verification. What documents lose is cut to chunks of its source, and joined to the batch of the source, where the words
   at the source coordinates must have the same digest.

Batches and hash ranges are sized by the text, not by the number of partitions, and a batch never sends more rows than it
has keys. It sends each key once, however often its documents repeat it, so no key is hot."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, in_runs, inflated, materialise, ship
from tallyforge.llm.graph import components

#: Words of a minimiser; multipliers of the two rolling hashes (3 modulo 8, so that swapped words don't cancel).
GRAM = 6
_M1, _M2 = 0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB53
_SECOND = np.uint64((1 << 24) - 1)
NO_ID = (1 << 63) - 1  # stands for a null id: smaller than none
WORDS_HELD = 300_000
#: Bytes of text of a run (it and its arrays are in memory at once), and of those that a hash range of the graph is for.
RUN_BYTES, SLICE_BYTES = 5 << 20, 16 << 20
#: Words of a chunk of a source whose digest is compared.
CHUNK = 32


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


@lru_cache(maxsize=4)
def _powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, m, np.uint64), np.full(n, pow(m, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(wh: np.ndarray, k: int, m: int) -> np.ndarray:
    """Hash of each run of k words, by prefix sums modulo 2^64."""
    n = 1 << max(10, int(len(wh) - 1).bit_length())
    up, down = _powers(m, n)
    total = np.zeros(len(wh) + 1, np.uint64)
    np.cumsum(wh * up[: len(wh)], out=total[1:])
    return _mix((total[k:] - total[:-k]) * down[: len(wh) - k + 1])


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Whole numbers as planes of bytes, sorted ones as differences: planes of zeros, which Spark's codec shrinks."""
    v = values.astype(np.uint64)
    if ordered and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    return v.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes, ordered: bool = False) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(v, dtype=np.uint64) if ordered else v


class Batch:
    """Words of a batch's documents, end to end, as hashes."""

    def __init__(self, table: pa.Table, lower: bool = False) -> None:
        self.table = table = table.sort_by("row")  # a place in the batch names the same word in every step
        ids = table.column("doc_id").to_pylist()
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.null = [i is None for i in ids]
        self.bodies = list(inflated(table.column("body")))
        look, parts = _hashes.__getitem__, []
        for body in self.bodies:
            words = (body.lower() if lower else body).split()
            parts.append(np.fromiter(map(look, words), np.uint64, len(words)))
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.wh = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(parts)), self.counts)

    def windows(self, k: int) -> np.ndarray:
        """Positions of the k-mers, none across documents."""
        n = len(self.wh) - k + 1
        return np.nonzero(self.owner[:n] == self.owner[k - 1 :])[0] if n > 0 else np.zeros(0, np.int64)

    def minimisers(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each k-mer: the place of its minimiser (the leftmost of equals), and 48 bits of its hash."""
        g = _grams(self.wh, GRAM, _M1)
        place = np.empty(len(at), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(g, k - GRAM + 1)
        for s in range(0, len(at), 1 << 18):
            part = at[s : s + (1 << 18)]
            place[s : s + len(part)] = part + view[part].argmin(axis=1)
        return place, g[place] >> np.uint64(16)


def _slices(sorted_keys: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """Bounds of equal hash ranges in sorted keys."""
    cuts = np.array([(i << bits) // slices for i in range(1, slices)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, cuts), [len(sorted_keys)]])


def _rows(names: dict[str, pa.DataType], cols: list[list]) -> pa.Table:
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), cols, strict=True)})


_PATH = pa.struct({"src_batch": pa.int32(), "src_at": pa.int64(), "n": pa.int32(), "digest": pa.binary()})
ASK1 = {"slice": pa.int32(), "batch": pa.int32(), "a": pa.binary(), "flag": pa.binary()}
SAY1 = {"batch": pa.int32(), "slice": pa.int32(), "a": pa.binary()}
ASK2 = {"slice": pa.int32(), "batch": pa.int32(), "a": pa.binary(), "b": pa.binary(), "doc": pa.binary(), "at": pa.binary(), "flag": pa.binary()}
SAY2 = {"batch": pa.int32(), "slice": pa.int32(), "a": pa.binary(), "b": pa.binary(), "doc": pa.binary(), "src": pa.binary(), "at": pa.binary(), "own": pa.binary()}
_NODE = pa.struct({"node": pa.int64(), "at": pa.int32(), "enters": pa.int32(), "leaves": pa.int32()})
OUT = {"row": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string(), "paths": pa.list_(_PATH), "nodes": pa.list_(_NODE)}


def _ddl(names: dict[str, pa.DataType]) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    kinds |= {pa.list_(_PATH): "array<struct<src_batch: int, src_at: long, n: int, digest: binary>>", pa.list_(_NODE): "array<struct<node: long, at: int, enters: int, leaves: int>>"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in names.items())


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in keys that are sorted together."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.nonzero(new)[0]


def ask_minimisers(table: pa.Table, k: int, slices: int) -> pa.Table:
    b = Batch(table)
    at = b.windows(k)
    if not len(at):
        return _rows(ASK1, [[]] * 4)
    place, key = b.minimisers(at, k)
    once = _group_starts(place)
    key, own = key[once], b.owner[at[once]]
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    s = _group_starts(key)
    flag = np.minimum.reduceat(own, s) != np.maximum.reduceat(own, s)
    key = key[s]
    cut = _slices(key, slices, 48)
    some = [i for i in range(slices) if cut[i] < cut[i + 1]]
    batch = table.column("batch")[0].as_py()
    return _rows(ASK1, [some, [batch] * len(some), [pack(key[cut[i] : cut[i + 1]], True) for i in some], [np.packbits(flag[cut[i] : cut[i + 1]]).tobytes() for i in some]])


def say_minimisers(table: pa.Table) -> pa.Table:
    batches = table.column("batch").to_pylist()
    keys = [unpack(x, True) for x in table.column("a").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8))[: len(x)].astype(bool) for f, x in zip(table.column("flag").to_pylist(), keys, strict=True)]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[x[f] for x, f in zip(keys, flags, strict=True)]]))
    found = [x[_within(x, twice)] for x in keys]
    some = [i for i, x in enumerate(found) if len(x)]
    return _rows(SAY1, [[batches[i] for i in some], [table.column("slice")[0].as_py()] * len(some), [pack(found[i], True) for i in some]])


def _within(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def ask_edges(table: pa.Table, said: pa.Table, k: int, slices: int) -> pa.Table:
    if not table.num_rows or not said.num_rows:
        return _rows(ASK2, [[]] * 7)
    b = Batch(table)
    at = b.windows(k)
    repeated = np.sort(np.concatenate([unpack(x, True) for x in said.column("a").to_pylist()]))
    at = at[_within(b.minimisers(at, k)[1], repeated)]
    h1, h2 = _grams(b.wh, k, _M1)[at], _grams(b.wh, k, _M2)[at] & _SECOND
    doc = b.ids[b.owner[at]]
    order = np.lexsort((at, doc, h2, h1))
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    s = _group_starts(h1, h2)
    flag = doc[s] != doc[np.append(s[1:], len(doc)) - 1]
    h1, h2, doc, at = h1[s], h2[s], doc[s], at[s]
    cut = _slices(h1, slices, 64)
    some = [i for i in range(slices) if cut[i] < cut[i + 1]]
    part = lambda v, ordered=False: [pack(v[cut[i] : cut[i + 1]], ordered) for i in some]
    batch = table.column("batch")[0].as_py()
    return _rows(ASK2, [some, [batch] * len(some), part(h1, True), part(h2), part(doc), part(at), [np.packbits(flag[cut[i] : cut[i + 1]]).tobytes() for i in some]])


def say_edges(table: pa.Table) -> pa.Table:
    batches = table.column("batch").to_pylist()
    a = [unpack(x, True) for x in table.column("a").to_pylist()]
    b, doc, at = ([unpack(x) for x in table.column(c).to_pylist()] for c in ("b", "doc", "at"))
    flag = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8))[: len(x)].astype(bool) for f, x in zip(table.column("flag").to_pylist(), a, strict=True)])
    who = np.repeat(np.arange(len(a)), [len(x) for x in a])
    a, b, doc, at = (np.concatenate(x) for x in (a, b, doc, at))
    doc = doc.astype(np.int64)  # ids may be negative
    src = np.array(batches, np.int64)[who]
    order = np.lexsort((at, src, doc, b, a))
    a, b, doc, at, src, who, flag = (x[order] for x in (a, b, doc, at, src, who, flag))
    s = _group_starts(a, b)
    size = np.diff(np.append(s, len(a)))
    again = np.repeat((size > 1) | np.logical_or.reduceat(flag, s), size)
    own = doc
    first = again[s]  # of each repeated edge, its source
    first_who, first_at = who[s][first], at[s][first]
    doc, at, src = (np.repeat(x[s], size) for x in (doc, at, src))
    again &= flag | (own != doc)  # whoever is the source alone needs no answer
    rows: list[list] = [[] for _ in SAY2]
    for i, batch in enumerate(batches):
        m, mine = again & (who == i), np.sort(first_at[first_who == i])
        if m.any() or len(mine):
            for c, v in zip(rows, (batch, table.column("slice")[0].as_py(), pack(a[m], True), pack(b[m]), pack(doc[m]), pack(src[m]), pack(at[m]), pack(mine, True)), strict=True):
                c.append(v)
    return _rows(SAY2, rows)


_SPAN = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(body: bytes, gone: np.ndarray) -> bytes:
    """The text without some of its words: each goes with the white space after it; what stays is as it was."""
    starts = [m.start() for m in _SPAN.finditer(body)]
    ends = [*starts[1:], len(body)]
    return b"".join([body[s:e] for s, e, g in zip(starts, ends, gone.tolist(), strict=True) if not g]).rstrip(b" \t\n\r\x0b\x0c")


def _nodes(b: Batch, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Nodes of the batch's source edges (starts in order): place, hash, and whether an edge of the run enters and leaves it."""
    start = _group_starts(own - np.arange(len(own)))  # runs of edges that follow each other, never from one document to the next
    size = np.diff(np.append(start, len(own))) + 1
    place = np.repeat(own[start], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    enters, leaves = np.ones(len(place), np.int32), np.ones(len(place), np.int32)
    enters[np.cumsum(size) - size] = 0
    leaves[np.cumsum(size) - 1] = 0
    return place, _grams(b.wh, k - 1, _M1)[place].view(np.int64), enters, leaves


def remove(table: pa.Table, said: pa.Table, k: int, with_text: bool) -> pa.Table:
    """What stays of a batch's documents, and the paths they lost, cut to chunks of their source."""
    if not table.num_rows:
        out = _rows(OUT, [[]] * len(OUT))
        return out.append_column("carried", pa.chunked_array([[]], table.schema.field("carried").type)) if with_text else out
    b = Batch(table)
    gone = np.zeros(len(b.wh), bool)
    paths: dict[int, list] = {}
    if said.num_rows and len(at := b.windows(k)):
        cols = [np.concatenate([unpack(x, c == "a") for x in said.column(c).to_pylist()]) for c in ("a", "b", "doc", "src", "at")]
        order = np.lexsort((cols[1], cols[0]))
        a, bb, doc, src, src_at = (c[order] for c in cols)
        doc, src, src_at = doc.astype(np.int64), src.astype(np.int64), src_at.astype(np.int64)
        h1, h2 = _grams(b.wh, k, _M1)[at], _grams(b.wh, k, _M2)[at] & _SECOND
        hit = np.searchsorted(a, h1)
        end = len(a) - 1
        while (step := (hit <= end) & (a[np.minimum(hit, end)] == h1) & (bb[np.minimum(hit, end)] != h2)).any():
            hit += step  # equal first hashes lie side by side
        inside = np.minimum(hit, end)
        own = b.owner[at]
        out = (hit <= end) & (a[inside] == h1) & (bb[inside] == h2) & (doc[inside] < b.ids[own])
        at, own, src, src_at = at[out], own[out], src[inside][out], src_at[inside][out]
        if len(at):
            edge = np.zeros(len(b.wh) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + k, -1)
            gone = np.cumsum(edge[:-1]) > 0
            # edges that follow each other here and at their source are one path
            s = _group_starts(own, src, src_at - at, np.arange(len(at)) - at)
            last = np.append(s[1:], len(at)) - 1
            for o, *path in zip(own[s].tolist(), (at[s] - b.first[own[s]]).tolist(), (at[last] - at[s] + k).tolist(), src[s].tolist(), src_at[s].tolist(), strict=True):
                paths.setdefault(o, []).append(path)
    place = np.zeros(0, np.int64)
    if said.num_rows and not with_text:
        own = np.sort(np.concatenate([unpack(x, True) for x in said.column("own").to_pylist()]).astype(np.int64))
        if len(own):
            place, *node = _nodes(b, own, k)
    cut = np.searchsorted(place, b.first).tolist() + [len(place)]
    numbers = b.table.column("row").to_pylist()
    rows: list[list] = [[] for _ in OUT]
    sent: set[tuple] = set()
    for i, (f, n) in enumerate(zip(b.first.tolist(), b.counts.tolist(), strict=True)):
        body = b.bodies[i]
        words, g = body.split(), gone[f : f + n]
        kept = [w for w, x in zip(words, g.tolist(), strict=True) if not x] if g.any() else words
        text = None
        if with_text:
            text = (cut_text(body, g) if g.any() else body).decode("utf-8", "replace")
        lost = []
        for start, length, src, src_at in paths.get(i, ()):
            for s, e in _chunks(src_at, src_at + length):
                own = start + s - src_at
                key = (src, s, e - s, xxhash.xxh3_128_digest(b" ".join(words[own : own + e - s])))
                if key not in sent:
                    sent.add(key)
                    lost.append(dict(zip(("src_batch", "src_at", "n", "digest"), key, strict=True)))
        mine = slice(cut[i], cut[i + 1])
        nodes = [dict(zip(("at", "node", "enters", "leaves"), x, strict=True)) for x in zip((place[mine] - f).tolist(), *(x[mine].tolist() for x in node), strict=True)] if cut[i] < cut[i + 1] else []
        new = (numbers[i], None if b.null[i] else int(b.ids[i]), n, int(g.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), text, lost, nodes)
        for c, v in zip(rows, new, strict=True):
            c.append(v)
    out = _rows(OUT, rows)
    return out.append_column("carried", b.table.column("carried")) if with_text else out


def _chunks(start: int, end: int) -> list[tuple[int, int]]:
    """A stretch of a source cut at the multiples of CHUNK: however many copies a source has, few chunks of it differ."""
    cuts = [start, *range(start - start % CHUNK + CHUNK, end, CHUNK), end]
    return list(zip(cuts, cuts[1:], strict=False))


def verified(table: pa.Table, chunks: pa.Table) -> pa.Table:
    """No rows, after the words at each chunk's source coordinates proved to be those that another document lost."""
    want: dict[int, list] = {}
    if chunks.num_rows:
        b = Batch(table)
        for at, n, digest in zip(*(chunks.column(c).to_pylist() for c in ("src_at", "n", "digest")), strict=True):
            want.setdefault(int(np.searchsorted(b.first, at, "right")) - 1, []).append((at, n, digest))
    for row, some in want.items():
        words, first = b.bodies[row].split(), int(b.first[row])
        for at, n, digest in some:
            if xxhash.xxh3_128_digest(b" ".join(words[at - first : at - first + n])) != digest:
                raise ValueError(f"words of document {b.ids[row]}, position {at - first}, differ from their copy")
    return pa.table({"bad": pa.array([], pa.int64())})


def compacted(nodes: DataFrame, k: int) -> DataFrame:
    """Nonbranching paths of the graph of repeated edges, from its nodes (row, node, at, enters, leaves) in each source: of
    each path the row and place where its first piece starts, how many pieces it has, and its words.

    Nodes that lie in one run alone can't branch and aren't joined. Pieces that meet in a node that one edge enters and one
    leaves are links; their connected components, by joins, are the paths."""
    degrees = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("runs"), F.sum("enters").alias("in_"), F.sum("leaves").alias("out_")).filter("runs > 1")
    shared = materialise(nodes.join(degrees, "node").select("row", "node", "at", (F.greatest("in_", "out_") > 1).alias("branches")), "shared")
    ends = nodes.filter("enters = 0 or leaves = 0")
    inside = shared.join(ends.select("row", "at"), ["row", "at"], "left_anti").filter("branches")
    bounds = ends.select("row", "at", "node", "leaves").unionByName(inside.select("row", "at", "node", F.lit(1).alias("leaves")))
    here = Window.partitionBy("row").orderBy("at")
    pieces = bounds.withColumns({"end": F.lead("at").over(here), "end_node": F.lead("node").over(here)}).filter("leaves = 1")
    pieces = materialise(pieces.select(F.xxhash64("row", "at").alias("piece"), "row", "at", "end", "node", "end_node"), "pieces")
    joints = shared.filter("not branches").select("node").distinct()
    links = pieces.select(F.col("piece").alias("a"), F.col("end_node").alias("node")).join(joints, "node", "left_semi").join(pieces.select(F.col("piece").alias("b"), "node"), "node")
    links = materialise(links.filter("a != b").select("a", "b"), "links")
    roots = components(links).withColumnRenamed("node", "piece")
    whole = pieces.join(roots, "piece", "left").withColumn("root", F.coalesce("root", "piece"))
    place = F.min(F.struct("row", "at")).alias("first")
    paths = whole.groupBy("root").agg(place, F.count(F.lit(1)).alias("pieces"), (F.sum(F.col("end") - F.col("at")) + (k - 1)).cast("long").alias("words"))
    return paths.select("first.row", "first.at", "pieces", "words")


def substring_dedup(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_paths and longest_path (compacted repeated paths that
    first start in it, and the words of the longest). If asked for, instead of the paths, which aren't compacted then,
    kept_text, and as the struct `carried` the row itself without its text.

    A word goes if a window of k words over it also starts in a document with a smaller id. kept_text is the text
    without those words, its other white space as it was; a text that loses nothing is unchanged.

    Null texts have no words; texts under k words lose none; a very long text is a batch of its own size. Null ids are
    larger than any id and not smaller than each other. Rows that repeat an id don't remove each other's words. Other
    columns are ignored; an empty table gives an empty result. Raises if the words at a path's source coordinates differ (a
    collision of 88-bit hashes)."""
    ship(docs.sparkSession)
    rows = bodies(docs, id_col, text_col)
    if with_text:
        others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("body"), F.struct(*others).alias("carried"))
    dealt, n = in_runs(rows, RUN_BYTES, "runs")
    n = max(1, n * RUN_BYTES // SLICE_BYTES)
    plain = dealt.select("doc_id", "body", "row", "batch")
    asked = plain.groupBy("batch").applyInArrow(lambda t: ask_minimisers(t, k, n), _ddl(ASK1))
    said = asked.groupBy("slice").applyInArrow(say_minimisers, _ddl(SAY1))
    asked = plain.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(lambda t, s: ask_edges(t, s, k, n), _ddl(ASK2))
    said = asked.groupBy("slice").applyInArrow(say_edges, _ddl(SAY2))
    schema = _ddl(OUT) + (f", carried {rows.schema['carried'].dataType.simpleString()}" if with_text else "")
    whole = dealt if with_text else plain
    done = materialise(whole.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(lambda t, s: remove(t, s, k, with_text), schema), "cut")
    chunks = done.select(F.explode("paths").alias("p")).select(F.col("p.src_batch").alias("batch"), "p.src_at", "p.n", "p.digest").distinct()
    plain.groupBy("batch").cogroup(chunks.groupBy("batch")).applyInArrow(verified, "bad long").count()
    if with_text:
        return done.drop("row", "paths", "nodes")
    paths = compacted(done.select("row", F.inline("nodes")), k)
    per_row = materialise(paths.groupBy("row").agg(F.count(F.lit(1)).alias("n_paths"), F.max("words").alias("longest_path")), "paths")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = done.select("row", "doc_id", "n_words", "n_removed", "kept_sha256").join(per_row, "row", "left")
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256", zero("n_paths"), zero("longest_path"))
