"""Indexing queries over `documents` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.functions import scalars as X
from tallyforge.operators import index as I
from tallyforge.sources.tables import table

STORED = "s AS (SELECT 'p' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 4 <> 0)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("p"), i.cast("string")).alias("path")
    edited = F.when(i % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return d.filter("doc_id % 5 <> 0").select(path, F.sha2("text", 256).alias("content_hash")), d.filter("doc_id % 4 <> 0").select(path, edited.alias("content_hash"))


@query("incremental_sync", f"WITH {STORED} SELECT c.path, CASE WHEN s.h = c.h THEN 'skip' ELSE 'index' END AS action FROM c LEFT JOIN s USING (path) UNION ALL SELECT path, 'remove' FROM s WHERE path NOT IN (SELECT path FROM c)")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sync_plan(*snapshots(spark, sf_dir))


@query(
    "change_feed_sync",
    f"WITH {STORED} SELECT c.path, CASE WHEN s.h = c.h THEN 'skip' ELSE 'index' END AS action FROM c LEFT JOIN s USING (path) WHERE s.path IS NULL OR CAST(substr(c.path, 2) AS BIGINT) % 7 = 0 UNION ALL SELECT path, 'remove' FROM s WHERE path NOT IN (SELECT path FROM c)",
)
def change_feed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, current = snapshots(spark, sf_dir)
    return I.sync_plan(stored, current, current.filter(F.substring("path", 2, 20).cast("long") % 7 == 0))


@query("index_status", "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return I.status(d, d, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@query("pending_chunks", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pending(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@query(
    "feedback_status",
    """WITH k AS (SELECT doc_id, arg_max(action, fid) AS action FROM (SELECT doc_id, doc_id * 2 AS fid, CASE WHEN quality = 1 THEN 'accept' ELSE 'dismiss' END AS action FROM labels UNION ALL SELECT doc_id, doc_id * 2 + 1, CASE WHEN toxic = 1 THEN 'false_positive' ELSE 'accept' END FROM labels WHERE doc_id % 2 = 0) GROUP BY doc_id)
    SELECT doc_id AS finding_id, CASE WHEN action IN ('dismiss', 'false_positive') THEN 'suppressed' ELSE 'open' END AS status FROM documents LEFT JOIN k USING (doc_id)""",
)
def feedback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    first = lab.select(F.col("doc_id").alias("finding_id"), (F.col("doc_id") * 2).alias("feedback_id"), F.when(F.col("quality") == 1, "accept").otherwise("dismiss").alias("action"))
    second = lab.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("finding_id"), (F.col("doc_id") * 2 + 1).alias("feedback_id"), F.when(F.col("toxic") == 1, "false_positive").otherwise("accept").alias("action"))
    return I.feedback_status(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("finding_id"), F.lit("open").alias("status")), first.unionByName(second))


@query("rules_in_order", "SELECT 'R' || s_suppkey AS rule_id, s_nationkey AS hits, CAST(row_number() OVER (ORDER BY s_nationkey DESC, 'R' || s_suppkey) AS INT) AS ordinal FROM supplier WHERE s_acctbal > 0")
def rules_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("rule_id"), F.col("s_nationkey").alias("hits"), (F.col("s_acctbal") > 0).alias("active"))
    return I.rules_in_order(s).select("rule_id", "hits", "ordinal")


@query("embedding_texts", "SELECT doc_id, lang || ' in ' || source || ': ' || substr(text, 1, 40) || chr(10) || substr(text, 1, 1200) AS embedded FROM documents")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.finding_text(F.col("lang"), F.col("source"), F.substring("text", 1, 40), F.col("text")).alias("embedded"))


@query("module_names", r"SELECT page_id, regexp_replace(regexp_replace(url, '\.[^./]+$', ''), '/', '.', 'g') AS module FROM pages")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.dotted_module(F.col("url")).alias("module"))
