"""Best-fit packing by linear grouping: pieces of documents into as few sequences as possible."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, dense_ranks, materialise, ship
from tallyforge.llm.tokens import whole_texts

#: Pieces over this share of a sequence are grouped and configured; shorter ones fill what is left.
SMALL = 1 / 4
#: Groups of equal cardinality that long pieces are rounded up within.
GROUPS = 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, words: bool, end_id: int, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tok = whole_texts(path, words)
    end = np.array([end_id], tok.dtype).tobytes()
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(tok.encode(body) + end, tok.dtype).astype("<u4")
            view = memoryview(ids)
            cut = (len(ids) - 1) % size + 1
            bounds = [0, *range(cut, len(ids) + 1, size)]
            for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for c, v in zip(cols, (doc, k, s, e - s, zlib.crc32(view[s:e]), ids[s:e].tobytes() if with_ids else None), strict=True):
                    c.append(v)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


@dataclass
class Slots:
    """Where the pieces of one group go: ranks from `low` on, `per` to each of `count` sequences from number `first` on."""

    low: int
    per: int
    count: int
    first: int


def configurations(lengths: list[int], counts: list[int], size: int, groups: int = GROUPS) -> tuple[list[int], dict[int, list[Slots]], int]:
    """Linear grouping of long pieces, given how many there are of each length (longest first).

    Ranks of the sorted pieces are cut into groups of equal cardinality, each rounded up to its longest piece. A
    configuration takes the longest size left and fills the rest of the sequence as far as sizes left can (a bounded
    subset-sum over few sizes), and is used until one of its sizes runs out. Returns the first rank of each group, each
    group's slots (ranks count within the group), and the number of sequences."""
    total = sum(counts)
    if not total:
        return [], {}, 0
    ends = np.cumsum(counts)
    firsts = sorted({total * g // groups for g in range(groups)})
    sizes = [lengths[int(np.searchsorted(ends, f, side="right"))] for f in firsts]
    left = np.diff([*firsts, total]).tolist()
    used = [0] * len(firsts)
    slots: dict[int, list[Slots]] = defaultdict(list)
    sequences = 0
    for top in range(len(firsts)):
        while left[top]:
            take = _fill(sizes, left, top, size)
            times = min(left[g] // n for g, n in take.items())
            for g, n in take.items():
                slots[g].append(Slots(used[g], n, times, sequences))
                used[g] += n * times
                left[g] -= n * times
            sequences += times
    return firsts, dict(slots), sequences


def _fill(sizes: list[int], left: list[int], top: int, size: int) -> dict[int, int]:
    """A configuration with one piece of size `top` and the fullest choice of sizes left, as group -> pieces.

    reached[r] says whether r tokens can be had, group[r] and number[r] by what they first were; long sizes come first, so
    ties keep them, and of one size the fewest."""
    room = size - sizes[top]
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    group, number = np.full(room + 1, -1), np.zeros(room + 1, np.int64)
    for g in range(top, len(sizes)):
        s = sizes[g]
        most = min(left[g] - (g == top), room // s)
        if most <= 0:
            continue
        before = reached.copy()  # without this size, so that it counts once
        for n in range(1, most + 1):
            new = np.nonzero(before[: room + 1 - n * s] & ~reached[n * s :])[0] + n * s
            reached[new], group[new], number[new] = True, g, n
        if reached[room]:
            break
    take = {top: 1}
    at = int(np.nonzero(reached)[0][-1])
    while at:
        g, n = int(group[at]), int(number[at])
        take[g] = take.get(g, 0) + n
        at -= n * sizes[g]
    return take


@dataclass
class Fill:
    """Short pieces of one length: ranks from `low` on, `per` to each of `count` sequences of a residual class, from rank `first` on."""

    low: int
    per: int
    count: int
    residual: int
    first: int


def best_fit(smalls: dict[int, int], residuals: dict[int, int], size: int) -> tuple[dict[int, list[Fill]], int]:
    """Best fit of short pieces, longest first, by counts: `residuals` says how many sequences have how much room.

    A sequence is (its first residual, its rank there); ranges of ranks with equal room move together, and a range that
    takes a length keeps being the tightest for it until it can't hold another. New sequences have residual `size` and
    ranks beyond any old one's. Returns fills by length and how many sequences were added."""
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room left -> (first residual, rank from, count)
    for r, n in residuals.items():
        if n:
            room[r].append((r, 0, n))
    fills: dict[int, list[Fill]] = defaultdict(list)
    fresh = residuals.get(size, 0)
    added = 0
    for length in sorted(smalls, reverse=True):
        left, low = smalls[length], 0
        while left:
            fit = min((r for r, v in room.items() if r >= length and v), default=None)
            if fit is None:
                n = -(-left // (size // length))
                room[size].append((size, fresh, n))
                fresh, added, fit = fresh + n, added + n, size
            first, at, n = room[fit].pop()
            per = min(fit // length, left)
            n_used = min(n, left // per)
            if n > n_used:
                room[fit].append((first, at + n_used, n - n_used))
            room[fit - per * length].append((first, at, n_used))
            fills[length].append(Fill(low, per, n_used, first, at))
            low += per * n_used
            left -= per * n_used
    return dict(fills), added


def _by_rank(rank: np.ndarray, key: np.ndarray, plan: dict[int, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each (key, rank): the index of its plan entry in the list of its key, its sequence therein, its turn there."""
    entry, seq, turn = (np.zeros(len(rank), np.int64) for _ in range(3))
    for k in np.unique(key):
        at = np.nonzero(key == k)[0]
        lows = np.array([s.low for s in plan[int(k)]])
        e = np.searchsorted(lows, rank[at], side="right") - 1
        per = np.array([s.per for s in plan[int(k)]])[e]
        entry[at], seq[at], turn[at] = e, (rank[at] - lows[e]) // per, (rank[at] - lows[e]) % per
    return entry, seq, turn


def _place_long(batches: Iterator[pa.RecordBatch], firsts: list[int], offset: dict[int, int], slots: dict[int, list[Slots]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lengths, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
        place = rank + np.array([offset[int(x)] for x in lengths], np.int64)
        g = np.searchsorted(np.array(firsts), place, side="right") - 1
        e, seq, turn = _by_rank(place - np.array(firsts)[g], g, slots)
        first = np.array([slots[int(k)][int(i)].first for k, i in zip(g, e, strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(first + seq), pa.array(g * 4096 + turn)], ["row", "sub", "length", "sequence_id", "turn"])


def _place_short(batches: Iterator[pa.RecordBatch], fills: dict[int, list[Fill]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lengths, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
        e, seq, turn = _by_rank(rank, lengths, fills)
        entry = [fills[int(k)][int(i)] for k, i in zip(lengths, e, strict=True)]
        res = np.array([x.residual for x in entry], np.int64)
        at = np.array([x.first for x in entry], np.int64) + seq
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(res), pa.array(at), pa.array((1 << 30) - lengths * 4096 + turn)], ["row", "sub", "length", "residual", "rank", "turn"])


def _histogram(df: DataFrame, col: str) -> dict[int, int]:
    """Counts by a column that has at most as many values as a sequence has tokens."""
    return {r[0]: r[1] for r in df.groupBy(col).agg(F.count(F.lit(1))).collect()}


def pack(docs: DataFrame, path: str, words: bool, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its ids, then `end_id`; only one longer than `size` is cut, into pieces of `size`, its first piece
    shorter where it doesn't divide. Full pieces are sequences. Of the others, those over SMALL of a sequence are ranked
    by length across the table without gathering a group, grouped and configured; each slot then takes an actual
    document, whose true length decides the room left; short pieces go to the tightest room. The driver sees counts by
    length and by room (at most `size` each), and plans whose size depends on `size` and GROUPS alone.

    Null and empty texts are the end id alone. Null or repeated ids are pieces of their own. Other columns are ignored;
    an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = bodies(docs, id_col, text_col).mapInArrow(lambda it: _pieces(it, path, words, end_id, size, with_ids), PIECES)
    # the row's number within its task and the task name it; written once, so they stay
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    lean = cut.select("row", "piece", "length")
    counts = _histogram(lean, "length")
    small = int(size * SMALL)
    long = {k: v for k, v in counts.items() if small < k < size}
    order = sorted(long, reverse=True)
    offset, total = {}, 0
    for k in order:
        offset[k], total = total, total + long[k]
    firsts, slots, sequences = configurations(order, [long[k] for k in order], size)

    ranked = dense_ranks(lean.filter(f"length < {size}"), "length", ["row"], parts).select("row", F.col("piece").alias("sub"), "length", "rank")
    ranked = materialise(ranked, "ranked")
    schema = "row long, sub int, length long, sequence_id long, turn long"
    placed = ranked.filter(f"length > {small}").mapInArrow(lambda it: _place_long(it, firsts, offset, slots), schema)
    placed = materialise(placed, "placed")
    room = placed.groupBy("sequence_id").agg((F.lit(size) - F.sum("length")).alias("residual"))
    room = materialise(dense_ranks(room, "residual", ["sequence_id"], parts), "room")
    fills, added = best_fit({k: v for k, v in counts.items() if k <= small}, _histogram(room, "residual"), size)
    fresh = spark.range(added).select((F.col("id") + sequences).alias("sequence_id"), F.lit(size).cast("long").alias("residual"), F.col("id").alias("rank"))
    short = ranked.filter(f"length <= {small}").mapInArrow(lambda it: _place_short(it, fills), "row long, sub int, length long, residual long, rank long, turn long")
    short = short.join(room.unionByName(fresh), ["residual", "rank"]).select("row", "sub", "length", "sequence_id", "turn")
    full = lean.filter(f"length = {size}").select("row", F.col("piece").alias("sub"), "length", (F.col("row") + (sequences + added)).alias("sequence_id"), F.lit(0).cast("long").alias("turn"))
    before = Window.partitionBy("sequence_id").orderBy("turn", "row").rowsBetween(Window.unboundedPreceding, -1)  # at most `size` pieces
    shared = placed.unionByName(short).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    at = shared.unionByName(full.withColumn("offset", F.lit(0).cast("long"))).select("row", "sequence_id", "offset")
    out = cut.join(at, "row").drop("row")
    return out if with_ids else out.drop("ids")
