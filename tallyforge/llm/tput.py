"""Ranked lexical search by the three-phase uniform threshold over term-partitioned postings.

A posting is a document and its impact in a term, by which a term's lists are sorted; an item's score sums the impacts of its
terms, weighted. Phase 1 fetches the heads of all lists: the k-th best of their partial sums, tau, is a lower bound. Phase
2 fetches every posting that makes up at least tau / m of an item's score, m lists each: a document that has none stays
below tau. Phase 3 looks up the exact scores of the documents whose upper bound still reaches the k-th best sum."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, materialise, ship

#: Bytes of text whose postings make one list of each term: a frequent term has many, so no task holds it whole.
RUN_BYTES = 8 << 20
#: Terms of items in one pass (about): what is broadcast. Items beyond go in further passes.
PASS_TERMS = 200_000
#: What isn't part of a term becomes a space, A to Z lower case; bytes from 0x80 stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The list that holds the ids of a run's documents.
_IDS = -1
_POSTINGS = "run long, term int, docs binary, impacts binary, ids array<long>"
_POSTING_SCHEMA = pa.schema([("run", pa.int64()), ("term", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()), ("ids", pa.list_(pa.int64()))])


def terms_of(body: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return body.translate(_TABLE).split()


@dataclass
class Items:
    """The items of one pass. Per item: its terms' numbers and weights, and, by phase, which impacts are fetched (`need`) and
    what a term that wasn't fetched adds at most (`rest`)."""

    lists: list[tuple[np.ndarray, np.ndarray]]
    need: list[np.ndarray]
    rest: list[np.ndarray]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        often = [Counter(terms_of(x.as_py())) for x in b.column(2)]
        counts = [len(c) for c in often]
        q, item = (b.column(i).take(pa.array(np.repeat(np.arange(b.num_rows), counts))) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([q, item, pa.array([t for c in often for t in c], pa.binary()), pa.array([n for c in often for n in c.values()], pa.int64())], ["q", "item_id", "term", "tf"])


def _statistics(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Bodies -> (term, n): documents that hold each wanted term; under -1 all with a term, under -2 all terms with repeats."""
    found: Counter = Counter()
    for b in batches:
        for body in b.column(1):
            terms = terms_of(body.as_py())
            if terms:
                found[-1] += 1
                found[-2] += len(terms)
                found.update(map(numbers.__getitem__, numbers.keys() & set(terms)))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "n"])


def _postings(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int], n_docs: int, n_terms: int, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Bodies -> per run and wanted term its documents' places and impacts, highest impact first; per run the documents' ids."""
    run, held = TaskContext.get().partitionId() << 32, 0
    ids: list[int | None] = []
    lists: defaultdict[int, tuple[list, list]] = defaultdict(lambda: ([], []))

    def made() -> pa.RecordBatch:
        rows = [{"run": run, "term": _IDS, "ids": ids}]
        for term in sorted(lists):
            docs, impacts = np.array(lists[term][0], "<u4"), np.array(lists[term][1], "<u4")
            order = np.argsort(-impacts.astype(np.int64), kind="stable")
            rows.append({"run": run, "term": term, "docs": docs[order].tobytes(), "impacts": impacts[order].tobytes()})
        return pa.RecordBatch.from_pylist(rows, _POSTING_SCHEMA)

    for b in batches:
        for i, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            body = body.as_py()
            terms = terms_of(body)
            if terms:
                often, m = Counter(terms), 75 + 25 * len(terms) * n_docs // n_terms
                for t in numbers.keys() & often.keys():
                    docs, impacts = lists[numbers[t]]
                    docs.append(len(ids))
                    impacts.append(1_000_000_000 * often[t] // (1000 * often[t] + 12 * m))
                ids.append(i)
            held += len(body)
            if held >= run_bytes:
                yield made()
                run, held, ids = run + 1, 0, []
                lists.clear()
    if ids:
        yield made()


def _arrays(docs: pa.Scalar, impacts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(docs.as_py(), "<u4"), np.frombuffer(impacts.as_py(), "<u4").astype(np.int64)


def _heads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists sorted by term -> the k postings of highest impact of each term in this task."""
    held: dict[int, list[tuple[int, int, int]]] = {}

    def out(found: list[tuple[int, list]]) -> pa.RecordBatch:
        rows = [(t, *x) for t, xs in found for x in xs]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["term", "impact", "run", "doc"])

    for b in batches:
        for run, term, docs, impacts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            docs, impacts = np.frombuffer(docs.as_py(), "<u4")[:k].tolist(), np.frombuffer(impacts.as_py(), "<u4")[:k].tolist()
            held[term] = sorted([*held.get(term, []), *((x, run, d) for d, x in zip(docs, impacts, strict=True))], reverse=True)[:k]
        last = max(held, default=0)
        yield out([(t, held.pop(t)) for t in sorted(held) if t != last])
    yield out(sorted(held.items()))


def _fetched(batches: Iterator[pa.RecordBatch], cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each list the postings whose impact reaches the least that an item asks of its term: a prefix."""
    for b in batches:
        rows = []
        for run, term, docs, impacts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            x = np.frombuffer(impacts.as_py(), "<u4")
            n = int(np.searchsorted(-x.astype(np.int64), -cut[term], "right"))
            if n:
                rows.append({"run": run, "term": term, "docs": docs.as_py()[: 4 * n], "impacts": impacts.as_py()[: 4 * n]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_POSTING_SCHEMA)[:4]))


def _accumulated(rows: pa.Table, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A run's fetched postings -> per item the partial sums and the upper bounds of all its documents."""
    held = {t: _arrays(d, x) for t, d, x in zip(rows.column("term").to_pylist(), rows.column("docs"), rows.column("impacts"), strict=True)}
    width = 1 + max((int(d.max()) for d, _ in held.values()), default=-1)
    for q, (terms, weights) in enumerate(items.lists):
        sums, more = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for t, w, need, rest in zip(terms.tolist(), weights.tolist(), items.need[q].tolist(), items.rest[q].tolist(), strict=True):
            if t in held:
                docs, x = held[t]
                n = int(np.searchsorted(-x, -need, "right"))
                sums[docs[:n]] += w * x[:n]
                more[docs[:n]] += rest
        yield q, sums, np.where(sums > 0, sums + int(items.rest[q].sum()) - more, 0)


def _best_sums(rows: pa.Table, items: Items, k: int) -> pa.Table:
    qs, out = [], []
    for q, sums, _ in _accumulated(rows, items):
        top = np.sort(np.partition(sums, -k)[-k:] if len(sums) > k else sums)
        top = top[top > 0]
        qs.append(np.full(len(top), q, np.int32))
        out.append(top)
    return pa.table({"q": np.concatenate(qs), "score": np.concatenate(out)})


def _candidates(rows: pa.Table, items: Items, least: np.ndarray) -> pa.Table:
    run, qs, docs = rows.column("run")[0].as_py(), [], []
    for q, _, bounds in _accumulated(rows, items):
        d = np.nonzero(bounds >= max(int(least[q]), 1))[0]
        qs.append(np.full(len(d), q, np.int32))
        docs.append(d)
    qs = np.concatenate(qs)
    return pa.table({"run": pa.array(np.full(len(qs), run, np.int64)), "q": qs, "doc": np.concatenate(docs)})


def _exact(wanted: pa.Table, lists: pa.Table, items: Items, k: int) -> pa.Table:
    """A run's candidates and the lists of their items' terms, whole -> the k best of each item."""
    q, docs = wanted.column("q").to_numpy(), wanted.column("doc").to_numpy()
    order = np.lexsort((docs, q))
    q, docs = q[order], docs[order]
    held = {t: (d, x) for t, d, x in zip(lists.column("term").to_pylist(), lists.column("docs"), lists.column("impacts"), strict=True) if t != _IDS}
    ids = next(x.as_py() for t, x in zip(lists.column("term").to_pylist(), lists.column("ids"), strict=True) if t == _IDS)
    asked: defaultdict[int, list[tuple[slice, int]]] = defaultdict(list)
    for item in np.unique(q).tolist():
        at = slice(*np.searchsorted(q, [item, item + 1]).tolist())
        for t, w in zip(*(x.tolist() for x in items.lists[item]), strict=True):
            asked[t].append((at, w))
    score, impact = np.zeros(len(q), np.int64), np.zeros(len(ids), np.int64)
    for t in asked.keys() & held.keys():
        d, x = _arrays(*held[t])
        impact[d] = x
        for at, w in asked[t]:
            score[at] += w * impact[docs[at]]
        impact[d] = 0
    place = np.array([(1, 0) if ids[d] is None else (0, ids[d]) for d in docs.tolist()], np.int64).reshape(-1, 2)
    order = np.lexsort((docs, place[:, 1], place[:, 0], -score, q))
    keep = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
    keep = keep[score[keep] > 0]
    return pa.table({"q": q[keep], "doc_id": pa.array([ids[d] for d in docs[keep].tolist()], pa.int64()), "score": score[keep], "doc": docs[keep], "run": np.full(len(keep), wanted.column("run")[0].as_py(), np.int64)})


def _kth(df: DataFrame, k: int, n: int) -> np.ndarray:
    """The k-th highest score of each item, 0 where there are fewer."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    rows = df.select("q", "score", place.alias("place")).filter(F.col("place") == k).select("q", "score").toArrow()
    out = np.zeros(n, np.int64)
    out[rows.column("q").to_numpy()] = rows.column("score").to_numpy()
    return out


def _pass(spark: SparkSession, texts: DataFrame, rows: pa.Table, k: int, run_bytes: int) -> DataFrame | None:
    """All documents ranked for the items of `rows` (q, item_id, term, tf)."""
    distinct = sorted(set(rows.column("term").to_pylist()))
    numbers = {t: i for i, t in enumerate(distinct)}
    shared = spark.sparkContext.broadcast(numbers)
    counted = texts.mapInArrow(lambda it: _statistics(it, shared.value), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n_of = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    n_docs, n_terms = n_of.get(-1, 0), n_of.get(-2, 0)
    if not n_docs:
        return None
    weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for i, n in n_of.items() if i >= 0}
    made = texts.mapInArrow(lambda it: _postings(it, shared.value, n_docs, n_terms, run_bytes), _POSTINGS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = materialise(made.repartitionByRange(parts, "term", "run").sortWithinPartitions("term", "run"), "postings")
    lists_only = postings.filter(F.col("term") != _IDS).select("run", "term", "docs", "impacts")

    by_item: dict[int, list[tuple[int, int]]] = {}
    names: dict[int, int | None] = {}
    for q, item, term, tf in zip(*(rows.column(c).to_pylist() for c in ("q", "item_id", "term", "tf")), strict=True):
        i = numbers[term]
        names[q] = item
        if weight.get(i, 0) > 0:
            by_item.setdefault(q, []).append((i, tf * weight[i]))
    if not by_item:
        return None
    order = sorted(by_item)
    items = Items([tuple(np.array(x, np.int64) for x in zip(*by_item[q], strict=True)) for q in order], [], [])
    flat = pa.table({"q": pa.array(np.repeat(np.arange(len(order)), [len(x[0]) for x in items.lists]).astype(np.int32)), "term": pa.array(np.concatenate([x[0] for x in items.lists]).astype(np.int32)), "weight": np.concatenate([x[1] for x in items.lists])})
    item_terms = F.broadcast(spark.createDataFrame(flat, "q int, term int, weight long"))

    # phase 1: list heads, and the k-th best partial sum of each item
    heads = lists_only.mapInArrow(lambda it: _heads(it, k), "term int, impact long, run long, doc long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "run", "doc"))
    heads = materialise(heads.withColumn("place", place).filter(F.col("place") <= k), "heads")
    sums = heads.join(item_terms, "term").groupBy("q", "run", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    tau = _kth(sums, k, len(order))
    top = heads.filter("place = 1").select("term", "impact").toArrow()
    most = dict(zip(top.column("term").to_pylist(), top.column("impact").to_pylist(), strict=True))

    # phase 2: every posting of at least tau / m
    cut = np.full(len(distinct), 2**62, np.int64)
    for (terms, weights), t in zip(items.lists, tau.tolist(), strict=True):
        need = -(-max(t, 1) // (len(terms) * weights))
        items.need.append(need)
        items.rest.append(weights * np.minimum(need - 1, np.array([most.get(i, 0) for i in terms.tolist()], np.int64)))
        np.minimum.at(cut, terms, need)
    held = spark.sparkContext.broadcast(items)
    sent = materialise(lists_only.mapInArrow(lambda it: _fetched(it, cut), "run long, term int, docs binary, impacts binary"), "fetched")
    best = sent.groupBy("run").applyInArrow(lambda t: _best_sums(t, held.value, k), "q int, score long")
    least = np.maximum(tau, _kth(best, k, len(order)))
    found = materialise(sent.groupBy("run").applyInArrow(lambda t: _candidates(t, held.value, least), "run long, q int, doc long"), "candidates")

    # phase 3: exact scores of what is left
    runs = found.select("run", "q").distinct()
    wanted = runs.join(item_terms, "q").select("run", "term").unionByName(runs.select("run", F.lit(_IDS).alias("term"))).distinct()
    lists = postings.join(wanted, ["run", "term"], "left_semi")
    exact = found.groupBy("run").cogroup(lists.groupBy("run")).applyInArrow(lambda a, b: _exact(a, b, held.value, k), "q int, doc_id long, score long, doc long, run long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "run", "doc"))
    ranked = exact.withColumn("rank", place).filter(F.col("rank") <= k)
    item_ids = spark.createDataFrame(pa.table({"q": pa.array(range(len(order)), pa.int32()), "item_id": pa.array([names[q] for q in order], pa.int64())}), "q int, item_id long")
    return ranked.join(F.broadcast(item_ids), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", run_bytes: int = RUN_BYTES, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of highest score above 0, equal scores by ascending id.

    Terms are runs of digits, letters and characters beyond ASCII, A to Z in lower case. N documents have a term, L is the
    number of all terms; w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L, and a document's score sums
    w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included.

    Null and empty texts have no term: such documents count nowhere, such items have no row. Rows that repeat an id are
    documents (or items) of their own; null ids come last among ties. Very long texts are whole; other columns are
    ignored; an empty table on either side gives an empty result.

    Items go in passes of about `pass_terms` terms, so that what is broadcast is bounded (by one item's own text at least)."""
    spark = docs.sparkSession
    ship(spark)
    texts = bodies(docs, id_col, text_col)
    asked = bodies(items, item_col, item_text_col).select(F.monotonically_increasing_id().alias("q"), F.col("doc_id").cast("long").alias("item_id"), "body")
    asked = materialise(asked.mapInArrow(_item_terms, "q long, item_id long, term binary, tf long"), "items")
    passes = max(1, -(-asked.count() // pass_terms))
    out = []
    for i in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == i).toArrow()
        found = _pass(spark, texts, rows, k, run_bytes) if rows.num_rows else None
        if found is not None:
            out.append(materialise(found, "ranked") if passes > 1 else found)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
