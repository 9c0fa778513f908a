"""Findings: collapse, caps, floors, verdicts, scores, the memory ladder and the verification fold.

A finding has review_id, finding_id (its ingest order), severity 'P0'..'P5', level 0..5 (0 worst), category,
conf (thousandths), and where needed fingerprint, title, body, locations. Every rank ends in finding_id, so the
reference order of ingest decides ties. Thousandths instead of floats keep sums and rounding exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Findings kept per level in one review, the total, floors, the confidence that needs no check.
LEVEL_CAPS = {3: 3, 4: 2, 5: 1}
MAX_FINDINGS = 12
LEAST_CONF = 350
SURE_CONF = 750
#: Similarity from which a finding is suppressed (security apart), and from which it is only downranked.
SUPPRESS, SUPPRESS_SECURITY, DOWNRANK = 0.92, 0.97, 0.80
DOWNRANK_FACTOR = 600
#: Characters that a reason for rejecting must have, and words that start an answer but give no reason.
REASON_CHARS = 40
SEVERITIES = ["P0", "P1", "P2", "P3", "P4", "P5"]
#: Openings of an answer that is no reason, and words of a rewritten body that talks about the finding.
PREAMBLE = r"(?i)^\s*(?:i (?:need|should|will|would|have) |let me |first[,. ]|to (?:verify|check)\b|i'?ll |looking at |i do not have |i don'?t have )"
WORKINGS = r"(?i)\bdowngrad|\bupgrad(?:e|ing) to p\d|\bthis is rated\b|\bthe finding is\b|\bwe cannot\b|\bi cannot confirm\b|\bconfidence\b|\bp\d requires\b|\bthe reviewer\b|\bverdict\b"
#: Weights of levels in the overall confidence, in halves.
LEVEL_WEIGHTS = {0: 6, 1: 5, 2: 4}


def _by_level(level: Column, values: dict[int, int], other: int) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in values.items()], F.lit(other))


def grave(df: DataFrame) -> DataFrame:
    """P10: security, or one of the two worst levels."""
    return df.withColumn("grave", (F.col("category") == "security") | (F.col("level") <= 1))


def policy_floor(df: DataFrame, floor: int = 5, least: int = LEAST_CONF) -> DataFrame:
    """At or above the severity floor (security always), and confident enough."""
    return df.filter(((F.col("category") == "security") | (F.col("level") <= floor)) & (F.col("conf") >= least))


def demote_advice(df: DataFrame) -> DataFrame:
    """Advice on missing tests is P4, or P5 where it already was."""
    hit = (F.col("category") == "test_gap") & (F.col("level") <= 4)
    return df.withColumn("level", F.when(hit, 4).otherwise(F.col("level"))).withColumn("severity", F.when(hit, F.lit("P4")).otherwise(F.col("severity")))


def needs_check(df: DataFrame) -> DataFrame:
    """Security, or grave without confidence; what a scanner found needs none."""
    scanned = F.coalesce(F.col("detector") == "secret_scan", F.lit(False))
    return df.withColumn("needs_check", ~scanned & ((F.col("category") == "security") | ((F.col("level") <= 1) & (F.col("conf") < SURE_CONF))))


def level_caps(df: DataFrame) -> DataFrame:
    """Within a review, the most confident findings of each capped level."""
    w = Window.partitionBy("review_id", "severity").orderBy(F.desc("conf"), "finding_id")
    return df.withColumn("rank_in_level", F.row_number().over(w)).filter(F.col("rank_in_level") <= _by_level(F.col("level"), LEVEL_CAPS, 2**31 - 1))


def total_cap(df: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """Within a review, the worst and most confident findings up to the cap."""
    w = Window.partitionBy("review_id").orderBy("level", F.desc("conf"), "finding_id")
    return df.withColumn("rank_in_review", F.row_number().over(w)).filter(F.col("rank_in_review") <= most)


def overflow(df: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """How many findings the total cap cuts, per review that loses any; for what the level caps left."""
    return df.groupBy("review_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("review_id", (F.col("n") - most).alias("overflow"))


def collapse(df: DataFrame) -> DataFrame:
    """One finding per fingerprint: the first one's columns, the highest confidence, the worst level with its label,
    and all locations in order of ingest without repeats."""
    firsts = [c for c in df.columns if c not in ("fingerprint", "conf", "level", "severity", "locations")]
    label = [F.concat(F.lit("P"), F.min("level").cast("string")).alias("severity")] if "severity" in df.columns else []
    locations = F.sort_array(F.collect_list(F.struct("finding_id", "locations")))
    return df.groupBy("fingerprint").agg(
        *[F.min_by(c, "finding_id").alias(c) for c in firsts if c != "finding_id"],
        F.min("finding_id").alias("finding_id"),
        F.max("conf").alias("conf"),
        F.min("level").alias("level"),
        *label,
        F.array_distinct(F.flatten(F.transform(locations, lambda x: x["locations"]))).alias("locations"),
    )


def restore_lost(before: DataFrame, merged: DataFrame) -> DataFrame:
    """Grave findings that a merge lost come back: those with neither a fingerprint nor any location (structs of file and
    line) that is still there."""
    lost = grave(before).filter("grave").drop("grave").join(merged.select("fingerprint"), "fingerprint", "left_anti")
    places = lambda df: df.select("finding_id", F.explode("locations").alias("place"))
    covered = places(lost).join(places(merged).select("place").distinct(), "place", "left_semi").select("finding_id")
    return merged.unionByName(lost.join(covered, "finding_id", "left_anti").select(merged.columns))


def severity_counts(df: DataFrame) -> DataFrame:
    """Findings per review and level, zero where a review has none."""
    levels = df.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = df.groupBy("review_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    grid = df.select("review_id").distinct().join(F.broadcast(levels))  # six rows
    return grid.join(counts, ["review_id", "severity"], "left").select("review_id", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def verdict(df: DataFrame, reviews: DataFrame, fail_on: int = 1) -> DataFrame:
    """Changes are requested if a finding is at fail_on or worse; other findings comment; a review without approves."""
    worst = df.groupBy("review_id").agg(F.min("level").alias("worst"))
    said = F.when(F.col("worst") <= fail_on, F.lit("request_changes")).when(F.col("worst").isNotNull(), F.lit("comment")).otherwise(F.lit("approve"))
    return reviews.select("review_id").distinct().join(worst, "review_id", "left").select("review_id", said.alias("verdict"))


def score(df: DataFrame, coverage: DataFrame) -> DataFrame:
    """From 5 (clean, covered) down to 1, by the worst level and the share of units covered (hundredths)."""
    worst = df.groupBy("review_id").agg(F.min("level").alias("worst"))
    s = F.when(F.col("worst").isNull(), F.when(F.col("coverage") >= 80, 5).otherwise(4)).otherwise(
        F.greatest(F.lit(1), F.least(F.col("worst") + 1, F.lit(4)) - F.when(F.col("coverage") < 80, 1).otherwise(0))
    )
    return coverage.join(worst, "review_id", "left").select("review_id", s.cast("int").alias("score"))


def overall_confidence(df: DataFrame, coverage: DataFrame) -> DataFrame:
    """Weighted mean of confidences (worse levels weigh more) times the share of units covered (hundredths), in
    thousandths, half up; without findings 0.4 and 0.6 of the coverage."""
    w = _by_level(F.col("level"), LEVEL_WEIGHTS, 2).cast("long")
    sums = df.groupBy("review_id").agg(F.sum(w * F.col("conf")).alias("wc"), F.sum(w).alias("w"))
    mean = F.expr("(2 * wc * coverage + 100 * w) div (200 * w)")
    return coverage.join(sums, "review_id", "left").select("review_id", F.coalesce(mean, 6 * F.col("coverage") + 400).cast("long").alias("confidence"))


def merge_findings(df: DataFrame, floor: int = 5, most: int = MAX_FINDINGS, joined: DataFrame | None = None) -> DataFrame:
    """M4: collapse; `joined` (a merge of some of them, if there was one) takes their place, what it lost of the grave comes
    back; grave findings pass, the others go through floor, level caps and total cap."""
    one = collapse(df)
    one = grave(one if joined is None else restore_lost(one, joined.select(one.columns)))
    ordinary = total_cap(level_caps(one.filter(f"not grave and level <= {floor}")), most)
    return one.filter("grave").unionByName(ordinary.select(one.columns)).drop("grave")


def memory_ladder(df: DataFrame) -> DataFrame:
    """M1: by similarity to what was dismissed: suppressed, else downranked with less confidence, else kept."""
    security = F.col("category") == "security"
    enough = F.col("similarity") >= F.when(security, SUPPRESS_SECURITY).otherwise(SUPPRESS)
    allowed = ~security | (F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0)
    status = F.when(enough & allowed, F.lit("suppressed")).when(F.col("similarity") >= DOWNRANK, F.lit("downranked")).otherwise(F.lit("kept"))
    down = F.floor((F.col("conf") * DOWNRANK_FACTOR + 500) / 1000).cast("long")
    return df.withColumn("status", status).withColumn("conf", F.when(F.col("status") == "downranked", down).otherwise(F.col("conf")))


def verify_fold(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rejections with a reason go; one without leaves its confidence behind. A revision sets the level,
    and the body unless the new one only talks about the finding; a confirmation without a confidence adds 100."""
    has_body = "body" in verdicts.columns and "body" in df.columns
    v = verdicts.select("finding_id", "verdict", F.col("level").alias("new_level"), F.col("conf").alias("new_conf"), "reason", *([F.col("body").alias("new_body")] if has_body else []))
    j = df.join(v, "finding_id", "left")
    reason = F.trim(F.coalesce("reason", F.lit("")))
    reasoned = (F.col("verdict") == "reject") & (F.length(reason) >= REASON_CHARS) & ~reason.rlike(PREAMBLE)
    bare = (F.col("verdict") == "confirm") & F.col("new_conf").isNull()
    conf = F.when(bare, F.least(F.lit(1000), F.col("conf") + 100)).otherwise(F.coalesce("new_conf", "conf"))
    revised = F.coalesce(F.col("verdict") == "revise", F.lit(False))
    level = F.when(revised, F.coalesce("new_level", "level")).otherwise(F.col("level"))
    status = F.when(F.coalesce(reasoned, F.lit(False)), F.lit("rejected")).otherwise(F.lit("kept"))
    made = {"level": level, "conf": conf}
    if "severity" in df.columns:
        made["severity"] = F.when(revised & F.col("new_level").isNotNull(), F.concat(F.lit("P"), F.col("new_level").cast("string"))).otherwise(F.col("severity"))
    if has_body:
        body = F.trim(F.coalesce("new_body", F.lit("")))
        made["body"] = F.when(revised & (body != "") & ~body.rlike(WORKINGS), body).otherwise(F.col("body"))
    return j.select(*[made.get(c, F.col(c)).alias(c) for c in df.columns], status.alias("status"))
