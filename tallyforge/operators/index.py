"""Incremental indexing: what changed, what is removed, status, and resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync_plan(stored: DataFrame, current: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """M15, J13, J14 over (path, content_hash): what a sync does with each path: index, skip or remove.

    With a change feed only its paths and those never indexed are looked at; without one (full mode) all are. A path
    whose stored hash is the new one is skipped, a stored path that is gone is removed."""
    known = stored.select("path", F.col("content_hash").alias("stored_hash"))
    looked = current
    if changed is not None:
        fresh = current.join(stored.select("path"), "path", "left_anti").select("path")
        looked = current.join(changed.select("path").unionByName(fresh).distinct(), "path", "left_semi")
    j = looked.join(known, "path", "left")
    here = j.select("path", F.when(F.col("stored_hash") == F.col("content_hash"), F.lit("skip")).otherwise(F.lit("index")).alias("action"))
    gone = stored.join(current.select("path"), "path", "left_anti").select("path", F.lit("remove").alias("action"))
    return here.unionByName(gone)


def forget(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of some paths."""
    return {name: df.join(paths.select("path"), "path", "left_anti") for name, df in tables.items()}


def unresolve(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges into removed symbols keep their resolution but lose their target; those out of them go."""
    gone = removed.select("symbol_id").distinct()
    left = edges.join(gone.select(F.col("symbol_id").alias("src")), "src", "left_anti")
    mark = gone.select(F.col("symbol_id").alias("dst"), F.lit(True).alias("lost"))
    j = left.join(mark, "dst", "left")
    return j.withColumn("dst", F.when(F.col("lost"), F.lit(None)).otherwise(F.col("dst"))).drop("lost")


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """ST10: chunks without a vector yet: an anti-join, so a stopped run is resumed by running again."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def hydrate(neighbours: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours with their chunk, in their order; those whose chunk is gone are dropped."""
    return neighbours.join(chunks, "chunk_id")


def status(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(files, "files").join(one(chunks, "chunks")).join(one(vectors, "vectors")).join(one(pending(chunks, vectors), "pending"))  # one row each


def similar_code(queries: DataFrame, near: DataFrame, chunks: DataFrame, own: DataFrame, most: int = 10) -> DataFrame:
    """R2: the nearest chunks of other files than the unit's own, `most` per unit."""
    hits = hydrate(near, chunks).join(own.select("unit", "path"), ["unit", "path"], "left_anti").join(queries.select("unit"), "unit", "left_semi")
    w = Window.partitionBy("unit").orderBy("rank")
    return hits.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def feedback_status(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """The latest feedback decides: rejecting actions suppress a finding; feedback on unknown findings is left out."""
    known = feedback.join(findings.select("finding_id"), "finding_id", "left_semi")
    last = known.groupBy("finding_id").agg(F.max_by("action", "feedback_id").alias("action"))
    j = findings.join(last, "finding_id", "left")
    rejected = F.col("action").isin("false_positive", "dismiss", "style_rule")
    return j.withColumn("status", F.when(F.coalesce(rejected, F.lit(False)), F.lit("suppressed")).otherwise(F.col("status"))).drop("action")


def rules_in_order(rules: DataFrame) -> DataFrame:
    """Active rules by hits, then by id as text, so R10 comes before R2; a team's rules are few."""
    return rules.filter("active").withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("hits"), "rule_id")))
