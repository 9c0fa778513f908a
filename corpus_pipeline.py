"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, numbered, scratch, shared_dir
from tallyforge.llm.exact import exact_dedup
from tallyforge.llm.packing import pack
from tallyforge.llm.quality import quality_rules
from tallyforge.llm.similar import similar_dedup
from tallyforge.llm.substring import substring_dedup


def _only(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose number is among those of `kept`."""
    return docs.join(kept.select(F.col("doc_id").alias(row)), row, "left_semi").drop(row)


def _one_of_each(docs: DataFrame, row: str, classes: DataFrame, best: Callable[[Column], Column]) -> DataFrame:
    """Of the rows (doc_id, class) of `classes`, the one that is `best` by id, then by place; rows without an id come after all others."""
    ids = docs.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    order = F.struct(best(F.col("id")).alias("id"), F.col("doc_id").alias("row"))
    first = F.coalesce(F.min(F.when(F.col("id").isNotNull(), order)), F.min(F.struct(F.lit(0).cast("long").alias("id"), F.col("doc_id").alias("row"))))
    return classes.join(ids, "doc_id").groupBy("class").agg(first.alias("first")).select(F.col("first.row").alias("doc_id"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Each row is judged for itself, whether its id is null or another row has it too; null and empty texts are rejected;
    equal rows fare alike; a very long text is judged as a whole; an empty table stays empty; other columns stay as they are."""
    docs, row = numbered(docs)
    with scratch(spark):
        kept = materialise(quality_rules(docs, id_col=row).filter("kept").select("doc_id"), "kept", kept=True)
    return _only(docs, row, kept)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: that with the largest id, of equal ids the first.

    Null and empty texts are equal; a row with a null id stays only where no equal text has an id; very long texts are
    compared as a whole; an empty table stays empty; other columns stay as they are."""
    docs, row = numbered(docs)
    with scratch(spark):
        classes = materialise(exact_dedup(docs, id_col=row).select("doc_id", F.col("keep_id").alias("class"), "group_size"), "classes", kept=True)
    several = _one_of_each(docs, row, classes.filter("group_size > 1").drop("group_size"), lambda c: -c)
    return _only(docs, row, classes.filter("group_size = 1").select("doc_id").unionByName(several))


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more), one row stays: that with the smallest id, of
    equal ids the first. Fingerprints meet by pigeonhole blocks, as in op4; whole sets of shingles decide.

    Null and empty texts are one group; a row with a null id stays only where its group has no id; very long texts are
    compared as a whole; an empty table stays empty; other columns stay as they are."""
    docs, row = numbered(docs)
    classes = materialise(similar_dedup(docs, id_col=row).select("doc_id", F.col("component_id").alias("class")), "classes")
    return _only(docs, row, _one_of_each(docs, row, classes, lambda c: c))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has go; every row stays, n_chars follows its text.

    Rows that repeat an id keep the words that they share; null ids are larger than any id; null texts become empty; an
    empty table stays empty; other columns stay as they are."""
    cut = substring_dedup(docs, with_text=True)
    change = F.col("n_removed") > 0
    made = {"text": F.col("kept_text"), "n_chars": F.when(change, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))}
    return cut.select(*[made.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 2048 tokens: a row per piece.

    Null and empty texts are an end id alone; rows that repeat an id, or have none, are each packed; very long texts are
    cut to pieces; an empty table gives no piece; other columns aren't returned."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), words=False, end_id=0)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", similar_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = shared_dir(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
    return docs


#: The quality verdict and the packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
