"""What the training-data operators share: shipping code, the shared folder, bodies as bytes, distributed ranks."""

from __future__ import annotations

import atexit
import io
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that ends a word, as bytes.split() has it: space and 0x09 to 0x0D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_shipped: set[str] = set()
_swept: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and keep Arrow batches small enough for very long texts."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[1]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        # the driver's own copy, which Spark's file server hands to the executors
        folder = tempfile.mkdtemp(prefix="ship-")
        at = os.path.join(folder, f"{root.name}_{os.getpid()}.zip")
        Path(at).write_bytes(packed.getvalue())
        spark.sparkContext.addPyFile(at)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; where that is unset, one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    top = f"{base.rstrip('/')}/tallyforge-{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        atexit.register(_sweep, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


_own: list[str] = []


def _own_dir() -> str:
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='tallyforge-')}")
    return _own[0]


def _sweep(spark: SparkSession, top: str) -> None:
    try:
        remove(spark, top)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: At the end of an execution its shuffle files go: what it wrote stands alone.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within go at its end, but for those written with `kept`: nothing else may then depend on them."""
    _scratch.append([])
    try:
        yield
    finally:
        for at in _scratch.pop():
            remove(spark, at)


def materialise(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage, survives lost executors, frees its shuffle files."""
    spark = df.sparkSession
    at = shared_dir(spark, name)
    if _scratch and not kept:
        _scratch[-1].append(at)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


#: Files of a table up to which its rows are numbered by file and place; beyond, the numbered table is written.
MOST_FILES = 100_000


def numbered(df: DataFrame, name: str = "row_number") -> tuple[DataFrame, str]:
    """`df` with a number of its own for each row, and that column's name, which no column has. The rows may be read more than
    once, at different times: of a table of files a row's number is that of its file and its place there, however the files
    are split and whichever executors there are; anything else is written with its numbers."""
    name, file, place = (_unused(df, c) for c in (name, "row_file", "row_place"))
    if "_metadata" not in df.columns and df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        found = df.select(F.col("_metadata.file_path").alias(file)).distinct().limit(MOST_FILES + 1).toArrow().column(0).to_pylist()
        if len(found) <= MOST_FILES:
            firsts = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(sorted(found))], f"`{file}` string, `{name}` long")
            placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)).join(F.broadcast(firsts), file)
            return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col(place)).alias(name)), name
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _unused(df: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def bodies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body): whole texts as UTF-8 bytes; null counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("body"))


def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies as zstd frames: half of what Spark's codec makes of them on their way to their run."""
    deflate = zstandard.ZstdCompressor(3).compress
    for b in batches:
        i = b.schema.get_field_index("body")
        yield b.set_column(i, "body", pa.array([deflate(x.as_py()) for x in b.column(i)], pa.binary()))


def inflated(bodies: pa.ChunkedArray) -> Iterator[bytes]:
    """The bodies that `deflated` packed, one at a time."""
    inflate = zstandard.ZstdDecompressor().decompress
    for x in bodies:
        yield inflate(x.as_py())


def run_count(spark: SparkSession, total: int, run_bytes: int) -> int:
    """Runs for so many bytes; small inputs have a run per MB, up to one per core."""
    return max(1, math.ceil(total / run_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(total / (1 << 20))))


def in_runs(rows: DataFrame, run_bytes: int, name: str) -> tuple[DataFrame, int]:
    """Deal rows with a `body`, which comes out deflated, to runs of about `run_bytes` each, whatever the number of partitions: adds `batch` (the run)
    and `row` (a number of its own for each row); returns how many runs there are.

    The rows are written first, so that their numbers stay. The deal hashes the number: no
    id, null or repeated, and no copied row is hot."""
    spark = rows.sparkSession
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "size": F.octet_length("body")})
    written = materialise(numbered.mapInArrow(deflated, numbered.schema), name)
    total = written.agg(F.sum("size")).first()[0] or 0
    n = run_count(spark, total, run_bytes)
    return written.drop("size").withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")), n


def dense_ranks(df: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """Add `rank`, long from 0, gapless within each value of `key`, without bringing a whole group to one task.

    Rows are hashed into `parts` slices by `order` (which must name a row), ranked within (slice, key), and shifted by
    the counts of earlier slices. `key` must have few values: the count table has parts x values rows."""
    sliced = df.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(parts)))
    within = Window.partitionBy("slice", key).orderBy(*order)
    sliced = sliced.withColumn("local_rank", F.row_number().over(within).cast("long") - 1)
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(parts))).groupBy("slice", key).agg(F.count(F.lit(1)).alias("n"))
    shift = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return sliced.join(shift, ["slice", key]).withColumn("rank", F.col("local_rank") + F.col("shift")).drop("slice", "local_rank", "shift")
