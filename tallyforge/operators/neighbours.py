"""Approximate nearest neighbours: an inverted file of quantised residuals, and exact distances for what comes near.

The coarse centres and the codebooks are fitted on a bounded sample; every vector is indexed, under its nearest centre, in
blocks of bounded size. A search compares codes in the lists nearest to each query and takes the best by exact distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.store import materialise

#: Vectors of the sample, lists, parts of a vector, centres of a part, and vectors of a block.
SAMPLE, LISTS, PARTS, CODES, BLOCK = 20_000, 64, 32, 256, 50_000
#: The share of true neighbours that the lists looked at should hold, as measured within the sample.
HELD = 0.98


@dataclass
class Model:
    """Coarse centres, codebooks (part, code, place), and lists to look at."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def residual_codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(v, self.centres)
        rest = (v - self.centres[lists]).reshape(len(v), self.books.shape[0], -1)
        return lists, np.stack([_nearest(rest[:, p], self.books[p]) for p in range(self.books.shape[0])], 1).astype(np.uint8)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(a[i : i + 4096], b).argmin(1) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0, np.int64)


def _means(v: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """k-means from rows spread over the sample; a centre without rows stays."""
    centres = v[np.linspace(0, len(v) - 1, min(n, len(v))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(v, centres)
        n_of = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, v)
        centres[n_of > 0] = sums[n_of > 0] / n_of[n_of > 0, None]
    return centres


def fit(vectors: DataFrame, k: int = 10, lists: int = LISTS, parts: int = PARTS) -> Model:
    """A model from up to SAMPLE of `vectors` (key, vector), chosen by a hash of the key. `probes` is the least number of lists
    that hold HELD of the k nearest of 256 sampled vectors."""
    n = vectors.count()
    share = max(1, n // SAMPLE)
    rows = vectors.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("vector").limit(SAMPLE).toArrow()
    v = np.array(rows.column("vector").to_pylist(), np.float64)
    if not len(v):
        return Model(np.zeros((1, 1)), np.zeros((1, 1, 1)), 1)
    parts = next(p for p in range(min(parts, v.shape[1]), 0, -1) if v.shape[1] % p == 0)
    centres = _means(v, min(lists, max(1, len(v) // 8)))
    rest = (v - centres[_nearest(v, centres)]).reshape(len(v), parts, -1)
    books = np.zeros((parts, min(CODES, len(v)), v.shape[1] // parts))
    for p in range(parts):
        books[p] = _means(np.ascontiguousarray(rest[:, p]), books.shape[1], 6)
    asked = v[:: max(1, len(v) // 256)]
    near = np.argsort(_distances(asked, v), 1)[:, 1 : k + 1]
    order = np.argsort(_distances(asked, centres), 1)
    rank = np.argsort(order, 1)
    ranks = np.sort(np.take_along_axis(rank, _nearest(v, centres)[near], 1).ravel())
    return Model(centres, books, int(ranks[min(len(ranks) - 1, int(HELD * len(ranks)))]) + 1 if len(ranks) else 1)


_INDEX = "list int, block int, key long, category string, code binary, vector array<float>"


def entries(vectors: DataFrame, model: Model) -> DataFrame:
    """(list, block, key, category, code, vector) of `vectors` (key, category, vector): what an index holds. Rows with a null or
    other width of vector are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, model.width))
            lists, codes = model.residual_codes(v)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], ["list", "key", "category", "code", "vector"])

    rows = vectors.filter(F.size("vector") == model.width).select(F.col("key").cast("long").alias("key"), F.col("category").cast("string").alias("category"), F.col("vector").cast("array<float>").alias("vector"))
    coded = materialise(rows.mapInArrow(run, "list int, key long, category string, code binary, vector array<float>"), "coded")
    blocks = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return coded.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("list", "block", "key", "category", "code", "vector")  # as many rows as lists


def build(vectors: DataFrame, model: Model, at: str) -> DataFrame:
    """Write the index of `vectors`, a folder per list, and read it."""
    entries(vectors, model).write.partitionBy("list").parquet(at)
    return read(vectors, at)


def insert(vectors: DataFrame, model: Model, at: str) -> DataFrame:
    """More vectors under the same model (SK7): appended files, no vector is coded again."""
    entries(vectors, model).write.mode("append").partitionBy("list").parquet(at)
    return read(vectors, at)


def read(df: DataFrame, at: str) -> DataFrame:
    return df.sparkSession.read.schema(_INDEX).parquet(at)


def search(queries: DataFrame, index: DataFrame, model: Model, k: int, again: int = 8) -> DataFrame:
    """T1, J8, J16 approximately: (key, category, neighbour, neighbour_category, d2, rank) as `memory.knn` gives them. `again` * k of
    each query, the nearest by codes, are compared exactly.

    Queries go to the blocks of their nearest lists, where codes are compared; no block and no query meets all of the other
    side. A null vector, or one of another width, finds nothing."""
    kind = "key long, category string, list int, q array<float>"

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, model.width))
            lists = np.argsort(_distances(q, model.centres), 1)[:, : model.probes]
            at = pa.array(np.repeat(np.arange(len(q)), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lists.ravel().astype(np.int32)), b.column(2).take(at)], ["key", "category", "list", "q"])

    def compared(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {c: [] for c in ("key", "neighbour", "near")}
        if asked.num_rows and held.num_rows:
            q = np.array(asked.column("q").to_pylist(), np.float64)
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            names, keys = held.column("key").to_numpy(), asked.column("key").to_numpy()
            rest = q - model.centres[held.column("list")[0].as_py()]
            coded = model.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)
            for i in range(len(q)):
                if i % 64 == 0:
                    # equal codes are equally near, whatever the order of a sum
                    some = _distances(rest[i : i + 64], coded).astype(np.float32)
                near = some[i % 64]
                near[(names == keys[i]) | np.isnan(near)] = np.inf
                best = np.flatnonzero(near <= np.partition(near, again * k - 1)[again * k - 1]) if len(near) > again * k else np.arange(len(near))
                best = best[np.lexsort((names[best], near[best]))[: again * k]]
                best = best[np.isfinite(near[best])]
                out["key"].append(np.full(len(best), keys[i]))
                out["neighbour"].append(names[best])
                out["near"].append(near[best].astype(np.float64))
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.float64() if c == "near" else pa.int64()) for c, x in out.items()})

    rows = queries.filter(F.size("vector") == model.width).select(F.col("key").cast("long").alias("key"), F.col("category").cast("string").alias("category"), F.col("vector").cast("array<float>").alias("vector"))
    asked = rows.mapInArrow(probed, kind)
    blocks = index.select("list", "block").distinct().toDF("list", "block")
    dealt = asked.join(blocks, "list")
    near = dealt.groupBy("list", "block").cogroup(index.select("list", "block", "key", "code").groupBy("list", "block")).applyInArrow(compared, "key long, neighbour long, near double")
    first = F.row_number().over(Window.partitionBy("key").orderBy("near", "neighbour"))
    some = near.withColumn("place", first).filter(F.col("place") <= again * k).select("key", "neighbour")
    vectors = index.select(F.col("key").alias("neighbour"), F.col("category").alias("neighbour_category"), F.col("vector").alias("v"))
    both = some.join(vectors, "neighbour").join(rows.withColumnRenamed("vector", "q"), "key")
    d2 = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double"))
    scored = both.select("key", "category", "neighbour", "neighbour_category", d2.alias("d2"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("d2", "neighbour"))).filter(F.col("rank") <= k)
