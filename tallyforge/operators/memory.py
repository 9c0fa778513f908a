"""Feedback, calibration and similarity to what was dismissed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weighted events from which a rate counts, the least correction (thousandths), neighbours considered.
LEAST_EVENTS, LEAST_CORRECTION, NEIGHBOURS = 5, 500, 40
#: Actions that calibrate, the accepting one first, and those that suppress a finding when it comes again.
CALIBRATING = ("accept", "false_positive")
DISMISSING = ("false_positive", "dismiss")


def calibration(feedback: DataFrame) -> DataFrame:
    """A8 to A10 per category: accepted and rejected weight, each action's weight raised by its distinct voices, the
    false-positive rate and the correction. Only CALIBRATING actions count. Weights are in tenths, results in fortieths, so
    all sums are whole."""
    feedback = feedback.filter(F.col("action").isin(*CALIBRATING))
    voice = F.coalesce("author", F.col("feedback_id").cast("string"))
    per = feedback.groupBy("category", "action").agg(F.sum("weight10").alias("w"), F.count_distinct(voice).alias("voices"))
    raised = F.col("w") * (4 + F.least(F.col("voices") - 1, F.lit(4)))
    side = lambda rejected: F.coalesce(F.sum(F.when((F.col("action") != CALIBRATING[0]) == rejected, raised)), F.lit(0))
    df = per.groupBy("category").agg(side(False).alias("accepted40"), side(True).alias("rejected40"))
    events = F.col("accepted40") + F.col("rejected40")
    rate = F.floor(1000 * F.col("rejected40") / F.greatest(events, F.lit(1))).cast("long")
    correction = F.when(events < 40 * LEAST_EVENTS, F.lit(1000)).otherwise(F.greatest(F.lit(LEAST_CORRECTION), 1000 - rate))
    return df.select("category", "accepted40", "rejected40", events.alias("events40"), rate.alias("fp_rate"), correction.cast("long").alias("correction"))


def calibrate(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """M3: confidence times the category's correction, half up in thousandths; categories without one are unchanged."""
    j = findings.join(stats.select("category", "correction"), "category", "left")
    c = F.coalesce("correction", F.lit(1000))
    return j.withColumn("stated_conf", F.when(c != 1000, F.col("conf"))).withColumn("conf", F.floor((F.col("conf") * c + 500) / 1000).cast("long")).drop("correction")


def calibration_report(stats: DataFrame) -> DataFrame:
    """Categories by weighted events, most first; a row per category."""
    w = Window.orderBy(F.desc("events40"), "category")
    return stats.withColumn("place", F.row_number().over(w))


def suppressors(feedback: DataFrame) -> DataFrame:
    """Per dismissed finding the summed weight and the first event's action, author and fingerprint."""
    rejecting = feedback.filter(F.col("action").isin(*DISMISSING) & F.col("finding_id").isNotNull())
    first = lambda c: F.min_by(c, "feedback_id").alias(c)
    return rejecting.groupBy("finding_id").agg(F.sum("weight10").alias("weight10"), first("fingerprint"), first("action"), first("author"))


def fingerprint_match(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose fingerprint was dismissed, by the last suppressor that has it."""
    last = known.groupBy("fingerprint").agg(F.max("finding_id").alias("suppressor"))
    return findings.join(last, "fingerprint").select("finding_id", "suppressor")


#: Vectors of the base and of the queries that one cell of the nearest-neighbour scan compares, at most (about), cells wanted, and
#: the fewest of each side that a cell is cut to for their sake.
BASE_LIMIT, QUERY_LIMIT, CELLS, LEAST_BASE, LEAST_QUERIES = 65_536, 8_192, 24, 2_048, 256


def _blocks(asked: int, held: int) -> tuple[int, int]:
    """Blocks of queries and of the base: as large as they may be, more where there would be fewer than CELLS cells."""
    n, m = max(1, -(-asked // QUERY_LIMIT)), max(1, -(-held // BASE_LIMIT))
    while n * m < CELLS:
        more, room = n <= m and 2 * n * LEAST_QUERIES <= asked, 2 * m * LEAST_BASE <= held
        if not (more or room or 2 * n * LEAST_QUERIES <= asked):
            break
        n, m = (2 * n, m) if more or not room else (n, 2 * m)
    return n, m


def knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k nearest base vectors of each query by squared distance (ties by key), exact.

    Both sides are hashed by key to blocks of bounded size; each block of queries meets each block of the base in a cell, which
    cuts to k per query before anything is shuffled again. Vectors that are null, hold a null or differ in width from
    the first of the base have no distance and come after all others."""
    first = base.filter("vector IS NOT NULL").select(F.size("vector").alias("n")).first()
    width = first.n if first else 0
    n, m = _blocks(queries.count(), base.count())
    number = "float" if all(df.schema["vector"].dataType.elementType.simpleString() == "float" for df in (queries, base)) else "double"

    def side(df: DataFrame, own: int, others: int, cell: Column, asked: bool) -> DataFrame:
        whole = F.coalesce((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull()), F.lit(False))
        rows = df.filter("key IS NOT NULL").select(F.lit(asked).alias("asked"), "key", "category", F.when(whole, F.col("vector").cast(f"array<{number}>")).alias("vector"), F.pmod(F.xxhash64("key"), F.lit(own)).cast("int").alias("block"))
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(cell.cast("int").alias("cell"), "asked", "key", "category", "vector")

    both = side(queries, n, m, F.col("block") * m + F.col("other"), True).unionByName(side(base, m, n, F.col("other") * m + F.col("block"), False))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"key {kind(queries, 'key')}, category {kind(queries, 'category')}, neighbour {kind(base, 'key')}, neighbour_category {kind(base, 'category')}, d2 double"
    near = both.repartition(2 * n * m, "cell").groupBy("cell").applyInArrow(lambda t: _nearest(t, k, width), schema)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("d2"), "neighbour"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, zeros for null ones, and which are null."""
    column = t.column("vector").combine_chunks()
    null = column.is_null().to_numpy(zero_copy_only=False)
    v = np.zeros((len(column), width), np.dtype(column.type.value_type.to_pandas_dtype()))
    v[~null] = column.flatten().to_numpy(zero_copy_only=False).reshape((~null).sum(), width)
    return v, null


def _spare(v: np.ndarray, null: np.ndarray, ordinal: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among anyone's k: of equal vectors, those of the k + 1 smallest keys, k of each key."""
    if not len(v):
        return np.zeros(0, np.int64)
    flat = np.ascontiguousarray(np.concatenate([v, null[:, None].astype(v.dtype)], 1))
    same = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * flat.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ordinal, same))
    s, o = same[order], ordinal[order]
    at = np.arange(len(s))
    new_group = np.r_[True, s[1:] != s[:-1]]
    new_key = new_group | np.r_[True, o[1:] != o[:-1]]
    keys = np.cumsum(new_key)
    nth_key = keys - keys[np.maximum.accumulate(np.where(new_group, at, 0))]
    nth_row = at - np.maximum.accumulate(np.where(new_key, at, 0))
    return np.sort(order[(nth_key <= k) & (nth_row < k)])


def _nearest(t: pa.Table, k: int, width: int) -> pa.Table:
    """A cell of `knn`. Distances by products tell who may be near, those by differences, summed in order, who is."""
    side = lambda asked: t.filter(pc.equal(t.column("asked"), asked)).select(["key", "category", "vector"])
    asked, held = side(True), side(False)
    (q, no_q), (v, no_v) = _matrix(asked, width), _matrix(held, width)
    keep = _spare(v, no_v, np.asarray(pc.rank(held.column("key").combine_chunks(), tiebreaker="dense")).astype(np.int64), k)
    held, v, no_v = held.take(pa.array(keep)), v[keep], no_v[keep]
    mine, names = asked.column("key").to_numpy(), held.column("key").to_numpy()
    ordinal = np.asarray(pc.rank(held.column("key").combine_chunks(), tiebreaker="dense")).astype(np.int64)
    wide = v.astype(np.float64)
    squares = (wide * wide).sum(1)
    longest = squares.max(initial=0, where=np.isfinite(squares))
    by_name = np.argsort(ordinal, kind="stable")
    froms, tos, d2s, unknown = [], [], [], []
    for at in range(0, len(q), 64):
        some = q[at : at + 64].astype(np.float64)
        own = (some * some).sum(1)
        with np.errstate(invalid="ignore", over="ignore"):
            near = own[:, None] + squares - 2 * (some @ wide.T)
        near[~(near < np.inf)] = np.inf
        near[no_q[at : at + 64]] = np.inf
        near[:, no_v] = np.inf
        slack = np.nan_to_num(1e-9 * (own + longest), nan=np.inf)
        head = near[:, : max(8192, k + 1)]
        # one more than k, as a query may be among them; a key that repeats is looked for below
        limit = np.partition(head, k, 1)[:, k] if head.shape[1] > k else np.full(len(some), np.inf)
        for i, x in enumerate(near):
            c = by_name if no_q[at + i] else np.flatnonzero(x <= limit[i] * (1 + 1e-6) + 2 * slack[i])
            c = c[names[c] != mine[at + i]]
            if no_q[at + i]:
                c = c[:k]
            elif len(c) < k:
                c = np.flatnonzero(names != mine[at + i])
            if len(c) > k:
                bound = np.partition(x[c], k - 1)[k - 1]
                c = c[x[c] <= bound * (1 + 1e-6) + 2 * slack[i]]
            null = no_v[c] | no_q[at + i]
            with np.errstate(invalid="ignore", over="ignore"):
                terms = v[c] - q[at + i]
                terms = (terms * terms).astype(np.float64)
                d2 = np.zeros(len(c))
                for j in range(width):
                    d2 += terms[:, j]
            best = np.lexsort((ordinal[c], d2, np.isnan(d2), null))[:k]
            froms.append(np.full(len(best), at + i))
            tos.append(c[best])
            d2s.append(d2[best])
            unknown.append(null[best])
    joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    a, b = (pa.array(joined(x, np.int64), pa.int64()) for x in (froms, tos))
    far = pa.array(joined(d2s, np.float64), pa.float64(), mask=joined(unknown, bool))
    return pa.table({"key": asked.column("key").take(a), "category": asked.column("category").take(a), "neighbour": held.column("key").take(b), "neighbour_category": held.column("category").take(b), "d2": far})


def matches(findings: DataFrame, near: DataFrame, known: DataFrame) -> DataFrame:
    """M2: each finding's match: the suppressor of its fingerprint (similarity 1), else the similar one."""
    exact = fingerprint_match(findings, known).select("finding_id", F.col("suppressor").alias("exact"))
    similar = near.select(F.col("key").alias("finding_id"), "suppressor", "similarity")
    j = exact.join(similar, "finding_id", "full")
    hit = F.col("exact").isNotNull()
    return j.select("finding_id", F.coalesce("exact", "suppressor").alias("suppressor"), F.when(hit, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"), F.when(hit, F.lit("fingerprint")).otherwise(F.lit("vector")).alias("by"))


def provenance(found: DataFrame, matched: DataFrame, reasons: DataFrame) -> DataFrame:
    """What became of each matched finding, and why: status, the suppressor, similarity to four places, who and reason."""
    why = reasons.select(F.col("finding_id").alias("suppressor"), F.col("author").alias("by_whom"), "reason")
    j = matched.join(found.select("finding_id", "status"), "finding_id").join(why, "suppressor", "left")
    return j.select("finding_id", "status", "suppressor", F.round("similarity", 4).alias("similarity"), "by_whom", "reason")


def remembered(kept: DataFrame, suppressed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of kept and suppressed findings (rejected ones are forgotten); a finding without a vector has no row."""
    both = kept.select("finding_id").unionByName(suppressed.select("finding_id")).distinct()
    return vectors.join(both, "finding_id", "left_semi")


def similarity_match(neighbours: DataFrame, known: DataFrame) -> DataFrame:
    """Of the nearest NEIGHBOURS of any category, the nearest suppressor of the finding's own category."""
    near = neighbours.filter((F.col("rank") <= NEIGHBOURS) & (F.col("category") == F.col("neighbour_category")))
    hits = near.join(known.select(F.col("finding_id").alias("neighbour")), "neighbour", "left_semi")
    first = hits.groupBy("key").agg(F.min_by(F.struct("neighbour", "d2"), "rank").alias("h"))
    return first.select("key", F.col("h.neighbour").alias("suppressor"), F.greatest(F.lit(0.0), 1 - F.col("h.d2") / 2).alias("similarity"))
