"""Hard negatives by one-dimensional distance keys: every vector is stored under (pivot, distance to that pivot), sorted, and a
search reads key intervals around the anchor's own distance that grow until what is left is provably too far.

Scores are inner products, which a distance doesn't order; so each vector gets one more component that brings it to the
largest norm M of all, and an anchor gets a zero there. Then distance^2 = |anchor|^2 + M^2 - 2 score, and a range of scores is
an annulus around the anchor. By the triangle inequality a vector at distance at most r from the anchor has a key within
r of the anchor's distance to the pivot, and none nearer than r lies under a key of less than r minus that distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, ship

#: Pivots, and rows of the sample from which they are fitted and first radii are guessed. All rows are indexed.
PIVOTS, SAMPLE = 64, 4096
#: Anchors of one pass (about): their vectors and what is found for them are what the driver and each task hold.
ANCHORS = 8192
#: The place of rows without an id among ties.
NO_ID = 2**63 - 1
#: Targets whose scores with a batch are looked at together.
_AT_ONCE = 1024
_FOUND = "target int, score long, id long"


@dataclass
class Space:
    """The augmented space: width, M^2, and the pivots in it."""

    width: int
    most: int
    pivots: np.ndarray

    def exact(self) -> type:
        """Numbers in which no inner product, nor a part of its sum, is rounded: each is at most M^2."""
        return np.float32 if self.most < 2**24 else np.float64 if self.most < 2**53 else np.int64

    def augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(self.most - (v * v).sum(1, keepdims=True), 0))])

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * points @ self.pivots.T, 0))


@dataclass
class Targets:
    """What is searched in one pass: for target t the best `k` rows by (score, id) with low <= score <= high, of its anchor's label
    or of others. `reach`: rows up to that distance are certainly found at the end of the round, up to `before` they already are."""

    anchors: np.ndarray  # vectors
    rows: np.ndarray
    labels: np.ndarray
    away: np.ndarray  # the anchors' distances to the pivots
    anchor: np.ndarray  # of each target
    low: np.ndarray
    high: np.ndarray
    inner: np.ndarray
    reach: np.ndarray
    before: np.ndarray
    least: np.ndarray  # score of the last of k known rows
    same: bool
    k: int


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of `width`, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Centres of the sample: ten rounds of k-means, from rows spread over it."""
    centres = points[:: max(1, len(points) // n)][:n].copy()
    for _ in range(10):
        nearest = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
        for c in np.unique(nearest):
            centres[c] = points[nearest == c].mean(0)
    return centres


def _keys(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, label, v) with the nearest pivot and the distance to it."""
    for b in batches:
        away = space.to_pivots(space.augmented(_matrix(b.column(3), space.width)))
        pivot = away.argmin(1)
        yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(away[np.arange(len(pivot)), pivot]), *b.columns], ["pivot", "dist", *b.schema.names])


def _best(target: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best k of each target, in order."""
    order = np.lexsort((id, -score, target))
    target, score, id = target[order], score[order], id[order]
    first = np.searchsorted(target, target)
    keep = np.arange(len(target)) - first < k
    return target[keep], score[keep], id[keep]


def _slack(space: Space) -> float:
    """More than rounding can move a distance."""
    return 1e-6 * (1 + space.most**0.5)


def _scan(batches: Iterator[pa.RecordBatch], t: Targets, space: Space) -> Iterator[pa.RecordBatch]:
    """Index rows in the order of their keys -> the best rows of each target among those in its key intervals."""
    kind, slack = space.exact(), _slack(space)
    vectors, least = t.anchors.astype(kind), np.maximum(t.least, t.low)
    held: list[tuple[np.ndarray, ...]] = []

    def segment(pivot: int, key: np.ndarray, row: np.ndarray, id: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        away = t.away[t.anchor, pivot]
        meets = (key.min() <= away + t.reach + slack) & (key.max() >= away - t.reach - slack) & (key.max() >= t.inner - away - slack)
        meets &= ~((key.min() >= away - t.before - slack) & (key.max() <= away + t.before + slack))
        wanted = np.nonzero(meets)[0]
        if not len(wanted):
            return
        some, place = np.unique(t.anchor[wanted], return_inverse=True)
        scores = (vectors[some] @ v.T.astype(kind)).astype(np.int64)
        for at in range(0, len(wanted), _AT_ONCE):
            x, s = wanted[at : at + _AT_ONCE], scores[place[at : at + _AT_ONCE]]
            fits = (s >= least[x, None]) & (s <= t.high[x, None]) & ((t.labels[t.anchor[x], None] == label) == t.same)
            i, j = np.nonzero(fits)
            i, score = x[i], s[i, j]
            gap = np.abs(key[j] - away[i])
            new = (gap > t.before[i] + slack) & (gap <= t.reach[i] + slack) & (t.rows[t.anchor[i]] != row[j])
            if new.any():
                held.append((i[new], score[new], id[j[new]]))
        if sum(len(x[0]) for x in held) > 200_000:
            pressed()

    def pressed() -> None:
        target, score, id = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), t.k)
        held[:] = [(target, score, id)]
        last = np.nonzero(np.bincount(target, minlength=len(least)) >= t.k)[0]
        least[last] = np.maximum(least[last], score[np.searchsorted(target, last, "right") - 1])

    for b in batches:
        pivot, key, row, id, label = (b.column(i).to_numpy() for i in range(5))
        v = _matrix(b.column(5), space.width)
        ends = [0, *(np.nonzero(np.diff(pivot))[0] + 1).tolist(), len(pivot)]
        for s, e in zip(ends, ends[1:], strict=False):
            if s < e:
                segment(int(pivot[s]), key[s:e], row[s:e], id[s:e], label[s:e], v[s:e])
    if held:
        pressed()
        target, score, id = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), pa.array(score), pa.array(id)], ["target", "score", "id"])


def _radius(t: Targets, space: Space, score: np.ndarray) -> np.ndarray:
    """The distance at which a row has that score with the target's anchor."""
    norm = (t.anchors.astype(np.float64) ** 2).sum(1)[t.anchor]
    return np.sqrt(np.maximum(norm + space.most - 2 * score.astype(np.float64), 0))


def _guessed(t: Targets, space: Space, sample: tuple[np.ndarray, ...]) -> np.ndarray:
    """A score that k rows of the sample, so at least k rows, reach for each target; its lower bound where they are fewer."""
    rows, labels, v = sample
    kind, out = space.exact(), t.low.copy()
    for at in range(0, len(t.anchor), _AT_ONCE // 2):
        x = slice(at, at + _AT_ONCE // 2)
        a = t.anchor[x]
        s = (t.anchors[a].astype(kind) @ v.T.astype(kind)).astype(np.int64)
        fits = (s >= t.low[x, None]) & (s <= t.high[x, None]) & ((t.labels[a, None] == labels) == t.same) & (t.rows[a, None] != rows)
        if v.shape[0] >= t.k:
            s = np.where(fits, s, -(2**62))
            out[x] = np.maximum(out[x], np.partition(s, -t.k, axis=1)[:, -t.k])
    return out


def _search(index: DataFrame, t: Targets, space: Space, sample: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(target, score, id) of the best rows of all targets, in order, certified by distance."""
    found = (np.zeros(0, np.int64),) * 3
    if not len(t.anchor):
        return found
    safe = _radius(t, space, _guessed(t, space, sample))  # enough rows lie within it, or none beyond are asked for
    t.inner = np.where(t.high < 2**62, _radius(t, space, np.minimum(t.high, 2**62)), 0.0)
    t.before = np.full(len(t.anchor), -1.0)
    t.reach = t.inner + (safe - t.inner) / 2
    t.least = t.low.copy()
    while True:
        spans = []
        for p in range(len(space.pivots)):  # the interval of keys that any target of this pass asks for
            away, slack = t.away[t.anchor, p], 2 * _slack(space)
            low, high = np.maximum(away - t.reach, t.inner - away) - slack, away + t.reach + slack
            asked = (t.reach > t.before) & (high >= 0)
            if asked.any():
                spans.append((F.col("pivot") == p) & F.col("dist").between(float(low[asked].min()), float(high[asked].max())))
        scanned = index.filter(reduce(lambda a, b: a | b, spans)) if spans else index.limit(0)
        shared = index.sparkSession.sparkContext.broadcast((t, space))
        rows = scanned.mapInArrow(lambda it, shared=shared: _scan(it, *shared.value), _FOUND)
        place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "id"))
        new = rows.withColumn("place", place).filter(F.col("place") <= t.k).drop("place").toArrow()
        shared.unpersist()
        found = _best(*(np.concatenate([a, new.column(c).to_numpy().astype(np.int64)]) for a, c in zip(found, ("target", "score", "id"), strict=True)), t.k)
        full = np.bincount(found[0], minlength=len(t.anchor)) >= t.k
        last = found[1][np.minimum(np.searchsorted(found[0], np.arange(len(full)), "right") - 1, len(found[1]) - 1)] if len(found[0]) else t.low
        t.least = np.where(full, last, t.low)
        need = np.where(full, np.minimum(_radius(t, space, t.least), safe), safe)
        if (need <= t.reach).all():
            return found
        t.before, t.reach = np.maximum(t.before, t.reach), np.maximum(need, t.reach)


def build_index(rows: DataFrame) -> tuple[DataFrame, Space, tuple[np.ndarray, ...]]:
    """(row, id, label, v) -> the table sorted by (pivot, dist), which rows of one key share by row number; its space; the sample."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if most is not None and most >= 2**62:
        raise ArithmeticError("scores don't fit 64-bit integers")
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(SAMPLE).toArrow()
    width, most = width or 0, int(most or 0)
    space = Space(width, most, np.zeros((1, width + 1)))
    v = _matrix(drawn.column("v"), width)
    if len(v):
        space.pivots = _pivots(space.augmented(v), PIVOTS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("row", "id", "label", "v").mapInArrow(lambda it: _keys(it, space), "pivot int, dist double, row long, id long, label long, v array<long>")
    index = materialise(keyed.repartitionByRange(parts, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row"), "index")
    return index, space, (drawn.column("row").to_numpy(), drawn.column("label").to_numpy(), v)


def mine_negatives(
    vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchors: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row whose id is divisible by
    `anchor_every`) and each of its first `positives` other rows of the same label, the first `negatives` rows of other labels
    with low * positive_score <= 100 * score <= high * positive_score. Scores are inner products of floor(scale * x); rows
    come by descending score, then id.

    Rows with a null label, a null vector or a component that is null or not finite take no part. A vector of fewer
    components is filled up with zeros. Rows without an id are no anchors and come last among ties (their id is then
    null); rows that repeat an id, or are equal, each take part. An empty table, or one without anchors or positives, gives an
    empty result; other columns are ignored. Scores beyond 64 bits raise.

    Anchors go in passes of about `anchors`; each round of a pass reads the key intervals of the sorted index that its
    targets still need, and cuts to the best rows within each task before anything is shuffled."""
    spark = vectors.sparkSession
    ship(spark)
    whole = F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.filter(whole).select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    index, space, sample = build_index(materialise(rows, "vectors"))
    chosen = index.filter((F.col("id") % anchor_every == 0) & (F.col("id") != NO_ID))
    passes = max(1, -(-chosen.count() // anchors))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = []
    for i in range(passes):
        those = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).select("row", "id", "label", "v").toArrow()
        q, n = _matrix(those.column("v"), space.width), those.num_rows
        row, id, label = (those.column(c).to_numpy() for c in ("row", "id", "label"))
        away, every = space.to_pivots(np.hstack([q.astype(np.float64), np.zeros((n, 1))])), np.arange(n)
        none = np.zeros(0)
        t = Targets(q, row, label, away, every, np.full(n, -(2**62)), np.full(n, 2**62), none, none, none, none, True, positives)
        a, score, positive = _search(index, t, space, sample)
        least = np.array([-(-low * int(s) // 100) for s in score], np.int64)
        most = np.array([high * int(s) // 100 for s in score], np.int64)
        open_ = least <= most
        a, score, positive = a[open_], score[open_], positive[open_]
        t = Targets(q, row, label, away, a, least[open_], most[open_], none, none, none, none, False, negatives)
        x, found, negative = _search(index, t, space, sample)
        rank = np.arange(len(x)) - np.searchsorted(x, x) + 1
        table = pa.table({"anchor_id": id[a[x]], "positive_id": positive[x], "rank": rank.astype(np.int32), "negative_id": negative, "positive_score": score[x], "negative_score": found})
        made = spark.createDataFrame(table, schema)
        out.append(materialise(made, "negatives") if passes > 1 else made)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return reduce(DataFrame.unionByName, out).select("anchor_id", null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score")
