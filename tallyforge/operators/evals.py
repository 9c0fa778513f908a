"""Evaluation: expectations against findings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.patterns import occurrences


def fitting(wanted: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs of `wanted` (case_id, no, file, pattern, category, severity) and findings (case_id, finding_no, file, category, severity,
    title, body) that fit: of the same case and file (a null or empty one is any), category (null is any), the pattern somewhere
    in title and body, whatever their case. Those with a file meet by it, so only patterns that any file may meet pair with all
    findings of a case."""
    w = wanted.select("case_id", "no", F.coalesce("file", F.lit("")).alias("file"), "pattern", F.col("category").alias("wanted"), F.col("severity").alias("expected"))
    text = F.concat("title", F.lit("\n"), F.coalesce("body", F.lit("")))
    f = findings.select("case_id", "finding_no", "file", "category", "severity", text.alias("text"))
    pairs = w.filter("file <> ''").join(f, ["case_id", "file"]).unionByName(w.filter("file = ''").drop("file").join(f, "case_id"))
    any_category = F.col("wanted").isNull() | (F.col("wanted") == "")
    return pairs.filter(F.expr("text rlike concat('(?i)', pattern)") & (any_category | (F.col("wanted") == F.col("category")))).select("case_id", "no", "finding_no", "expected", "severity")


def match_expectations(expects: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, no, finding_no, expected, severity): each expectation takes the first finding that fits and isn't taken, in the
    order of expectations. A task walks its cases' pairs in order and holds what the present case has taken, no more."""
    pairs = fitting(expects, findings)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "case_id").sortWithinPartitions("case_id", "no", "finding_no")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, done, taken = None, None, set()
        for b in batches:
            keep = []
            for c, no, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != case:
                    case, done, taken = c, None, set()
                fits = no != done and f not in taken
                if fits:
                    done = no
                    taken.add(f)
                keep.append(fits)
            yield b.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(walk, pairs.schema)


def eval_scores(cases: DataFrame, expects: DataFrame, forbids: DataFrame, findings: DataFrame) -> DataFrame:
    """A17, M16 per case of (case_id): expectations hit and missed, findings beyond as many as are expected, findings that a forbidden
    pattern meets (once for each), hits of another severity than expected, and whether it passed."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    matched = match_expectations(expects, findings)
    hit = matched.groupBy("case_id").agg(F.count(F.lit(1)).alias("hit"), F.count_if(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("severity"))).alias("severity_errors"))
    j = cases.select("case_id").distinct()
    for df in (count(expects, "expected"), hit, count(findings, "found"), count(fitting(forbids, findings), "forbidden_hits")):
        j = j.join(df, "case_id", "left")
    j = j.fillna(0, ["expected", "hit", "severity_errors", "found", "forbidden_hits"]).withColumn("missed", F.col("expected") - F.col("hit"))
    extra = F.greatest(F.lit(0), F.col("found") - F.col("expected"))
    passed = (F.col("missed") == 0) & (F.col("forbidden_hits") == 0) & (F.col("severity_errors") == 0)
    return j.select("case_id", "hit", "missed", extra.alias("extra"), "forbidden_hits", "severity_errors", passed.alias("passed"))


def passages(expected: DataFrame, docs: DataFrame) -> DataFrame:
    """J21, A17 over (item_id, text) and (doc_id, text): the first document that holds each passage, whatever its length or
    where it begins; a null passage is in none."""
    e = expected.select("item_id", F.col("text").alias("pattern")).distinct()
    hits = occurrences(docs.select(F.col("doc_id").alias("key"), "text"), e)
    first = hits.groupBy("pattern").agg(F.min("key").alias("doc_id"))
    return e.join(first, "pattern", "left").select("item_id", "doc_id", F.col("doc_id").isNotNull().alias("hit"))
