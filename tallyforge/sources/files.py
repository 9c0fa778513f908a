"""File sources and sinks: trees, blobs, diffs, golden cases, append and replace sinks. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "cases array<struct<id: string, diff: string, diff_file: string, expect: array<struct<file: string, pattern: string, category: string, severity: string>>, forbid: array<struct<file: string, pattern: string, category: string, severity: string>>>>"
SNIFFED = 8000


def tree(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """SC1, SC2: files below a folder of any store: path, size, binary (a NUL among the first bytes), blob (content hash).

    Without content asked for, only the hash and the sniff leave the scan."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace("path", f"^.*?{root.rstrip('/').rpartition('/')[2]}/", "")
    binary = F.coalesce(F.exists(F.regexp_extract_all(F.hex(F.expr(f"substring(content, 1, {SNIFFED})")), F.lit("(..)"), F.lit(1)), lambda b: b == "00"), F.lit(False))
    kept = [name.alias("path"), F.col("length").alias("size"), binary.alias("binary"), F.sha2("content", 256).alias("blob")]
    return df.select(*kept, F.col("content")) if with_content else df.select(*kept)


def diff_files(spark: SparkSession, glob: str) -> DataFrame:
    """SC3: one diff per file: diff_id (the file's name), text."""
    return spark.read.option("wholetext", "true").text(glob).select(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("diff_id"), F.col("value").alias("text"))


def golden_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SC9: cases (id, diff, diff_file), expectations and forbidden findings, each with its ordinal."""
    c = spark.read.schema(CASES).option("multiLine", "true").json(path).select(F.explode("cases").alias("c"))

    def listed(field: str) -> DataFrame:
        rows = c.select(F.col("c.id").alias("case_id"), F.posexplode(f"c.{field}").alias("expect_no", "e"))
        return rows.select("case_id", F.col("expect_no").cast("long").alias("expect_no"), "e.*")

    return c.select("c.id", "c.diff", "c.diff_file"), listed("expect"), listed("forbid")


def append(df: DataFrame, at: str, partition_by: str | None = None) -> None:
    """SK2, SK6: append to a table of Parquet files, partitioned so that trimming drops whole folders."""
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(at)


def swap(df: DataFrame, at: str) -> None:
    """SK1, SK4: write a whole new version beside the table; readers move on to the newest complete one."""
    spark = df.sparkSession
    versions = latest(spark, at)
    df.write.parquet(f"{at}/v{(versions if versions is not None else -1) + 1:06d}")


def latest(spark: SparkSession, at: str) -> int | None:
    """The newest complete version of a table written by swap()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    done = [s.getPath() for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(p.getName()[1:]) for p in done), default=None)


def read_latest(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}/v{latest(spark, at):06d}")
