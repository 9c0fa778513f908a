"""Finding queries. Adapters read `orders` as findings and `documents` as findings with fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.operators import findings as O
from tallyforge.operators import review as R
from tallyforge.operators import stats as S
from tallyforge.operators import text as T
from tallyforge.sources.tables import table

#: `orders` as findings, for the oracles.
FINDINGS = """f AS (SELECT o_orderkey AS finding_id, o_custkey AS review_id, 'P' || CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS VARCHAR) AS severity,
    CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS level, CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS conf,
    CASE o_orderstatus WHEN 'P' THEN 'security' WHEN 'F' THEN 'bug' ELSE 'test_gap' END AS category FROM orders)"""
CAP = "CASE level WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 2147483647 END"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as findings: level from the priority, confidence in thousandths from the price."""
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("finding_id"),
        F.col("o_custkey").alias("review_id"),
        F.concat(F.lit("P"), level.cast("string")).alias("severity"),
        level.alias("level"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % 1000).alias("conf"),
        F.when(status == "P", "security").when(status == "F", "bug").otherwise("test_gap").alias("category"),
    )


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as findings: the first 40 characters are the title, the source is the file."""
    d = table(spark, sf_dir, "documents")
    title = F.substring("text", 1, 40)
    return d.select(
        F.col("doc_id").alias("finding_id"),
        F.col("source").alias("file"),
        F.col("lang").alias("category"),
        T.fingerprint(F.col("source"), F.col("lang"), title).alias("fingerprint"),
        (F.col("n_chars") % 1000).alias("conf"),
        (F.col("doc_id") % 6).cast("int").alias("level"),
        (F.col("n_chars") % 50).cast("int").alias("line"),
        F.array(*[F.struct(F.col("source").alias("file"), line.cast("int").alias("line")) for line in (F.col("n_chars") % 50, 50 + F.col("doc_id") % 997)]).alias("locations"),
    )


PRINTED = r"""d AS (SELECT doc_id AS finding_id, source AS file, lang AS category,
    substr(sha256(concat_ws('|', source, lang, trim(regexp_replace(lower(substr(text, 1, 40)), '\s+', ' ', 'g')))), 1, 32) AS fingerprint,
    n_chars % 1000 AS conf, CAST(doc_id % 6 AS INT) AS level, CAST(n_chars % 50 AS INT) AS line FROM documents)"""


@query("finding_level_caps", f"WITH {FINDINGS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY review_id, severity ORDER BY conf DESC, finding_id) AS INT) AS rank_in_level FROM f) SELECT * FROM r WHERE rank_in_level <= {CAP}")
def finding_level_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.level_caps(findings(spark, sf_dir))


@query("finding_total_cap", f"WITH {FINDINGS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY level, conf DESC, finding_id) AS INT) AS rank_in_review FROM f) SELECT * FROM r WHERE rank_in_review <= 12")
def finding_total_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.total_cap(findings(spark, sf_dir))


@query("finding_overflow", f"WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY review_id, severity ORDER BY conf DESC, finding_id) AS k FROM f) SELECT review_id, count(*) - 6 AS overflow FROM r WHERE k <= {CAP} GROUP BY review_id HAVING count(*) > 6")
def finding_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overflow(O.level_caps(findings(spark, sf_dir)), 6)


@query("policy_floor", f"WITH {FINDINGS} SELECT * FROM f WHERE (category = 'security' OR level <= 3) AND conf >= 350")
def policy_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.policy_floor(findings(spark, sf_dir), 3)


@query("grave_split", f"WITH {FINDINGS} SELECT *, category = 'security' OR level <= 1 AS grave FROM f")
def grave_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.grave(findings(spark, sf_dir))


@query("needs_verification", f"WITH {FINDINGS} SELECT *, CAST(NULL AS VARCHAR) AS detector, category = 'security' OR (level <= 1 AND conf < 750) AS needs_check FROM f WHERE finding_id % 3 <> 0 UNION ALL SELECT *, 'secret_scan', false FROM f WHERE finding_id % 3 = 0")
def needs_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.needs_check(findings(spark, sf_dir).withColumn("detector", F.when(F.col("finding_id") % 3 == 0, F.lit("secret_scan"))))


@query("demote_advice", f"WITH {FINDINGS} SELECT finding_id, review_id, conf, category, CASE WHEN category = 'test_gap' AND level <= 4 THEN 4 ELSE level END AS level, CASE WHEN category = 'test_gap' AND level <= 4 THEN 'P4' ELSE severity END AS severity FROM f")
def demote_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.demote_advice(findings(spark, sf_dir))


@query(
    "severity_counts_zero_filled",
    f"WITH {FINDINGS}, l AS (SELECT unnest(['P0','P1','P2','P3','P4','P5']) AS severity) SELECT r.review_id, l.severity, count(f.finding_id) AS n FROM (SELECT DISTINCT review_id FROM f) r CROSS JOIN l LEFT JOIN f ON f.review_id = r.review_id AND f.severity = l.severity GROUP BY ALL",
)
def severity_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.severity_counts(findings(spark, sf_dir))


@query("verdict_per_review", f"WITH {FINDINGS} SELECT c_custkey AS review_id, CASE WHEN min(level) <= 1 THEN 'request_changes' WHEN min(level) IS NOT NULL THEN 'comment' ELSE 'approve' END AS verdict FROM customer LEFT JOIN f ON c_custkey = review_id GROUP BY c_custkey")
def verdict_per_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.verdict(findings(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("review_id")))


@query(
    "score_per_review",
    f"""WITH {FINDINGS}, w AS (SELECT review_id, min(level) AS worst FROM f GROUP BY review_id), c AS (SELECT c_custkey AS review_id, 60 + c_custkey % 41 AS coverage FROM customer)
    SELECT c.review_id, CAST(CASE WHEN worst IS NULL THEN CASE WHEN coverage >= 80 THEN 5 ELSE 4 END ELSE greatest(1, least(worst + 1, 4) - CASE WHEN coverage < 80 THEN 1 ELSE 0 END) END AS INT) AS score FROM c LEFT JOIN w USING (review_id)""",
)
def score_per_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.score(findings(spark, sf_dir), coverage(spark, sf_dir))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reviews, with the share of their units that was covered, in hundredths."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("review_id"), (60 + F.col("c_custkey") % 41).alias("coverage"))


@query("overall_confidence", f"WITH {FINDINGS}, w AS (SELECT *, CASE level WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 2 END AS w FROM f) SELECT c.review_id, CAST(CASE WHEN sum(w) IS NULL THEN 6 * any_value(coverage) + 400 ELSE (2 * sum(w * conf) * any_value(coverage) + 100 * sum(w)) // (200 * sum(w)) END AS BIGINT) AS confidence FROM (SELECT c_custkey AS review_id, 60 + c_custkey % 41 AS coverage FROM customer) c LEFT JOIN w ON c.review_id = w.review_id GROUP BY c.review_id")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overall_confidence(findings(spark, sf_dir), coverage(spark, sf_dir))


@query("fingerprint_sha", f"WITH {PRINTED} SELECT finding_id, fingerprint FROM d")
def fingerprint_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(spark, sf_dir).select("finding_id", "fingerprint")


COLLAPSED = f"""{PRINTED}, c AS (SELECT fingerprint, min(finding_id) AS finding_id, arg_min(file, finding_id) AS file, arg_min(category, finding_id) AS category, arg_min(line, finding_id) AS line,
    max(conf) AS conf, min(level) AS level FROM d GROUP BY fingerprint)"""


@query("collapse_identical", f"WITH {COLLAPSED}, l AS (SELECT fingerprint, count(DISTINCT (file, x)) AS n_locations FROM (SELECT fingerprint, file, unnest([line, 50 + finding_id % 997]) AS x FROM d) GROUP BY fingerprint) SELECT c.*, n_locations FROM c JOIN l USING (fingerprint)")
def collapse_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.collapse(printed(spark, sf_dir)).withColumn("n_locations", F.size("locations").cast("long")).drop("locations")


@query(
    "restore_lost",
    f"""WITH {PRINTED}, m AS (SELECT * FROM d WHERE finding_id % 3 = 0), p AS (SELECT file, unnest([line, 50 + finding_id % 997]) AS x FROM m), g AS (SELECT * FROM d WHERE level <= 1 AND fingerprint NOT IN (SELECT fingerprint FROM m) AND (file, line) NOT IN (SELECT file, x FROM p) AND (file, 50 + finding_id % 997) NOT IN (SELECT file, x FROM p))
    SELECT * FROM m UNION ALL SELECT * FROM g""",
)
def restore_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = printed(spark, sf_dir)
    return O.restore_lost(df, df.filter("finding_id % 3 = 0")).drop("locations")


#: Merged findings: documents as findings of 40 reviews, every seventh on security.
MERGED = f"""{PRINTED}, e AS (SELECT * EXCLUDE (category), CASE WHEN finding_id % 7 = 0 THEN 'security' ELSE category END AS category, finding_id % 40 AS review_id FROM d),
    c AS (SELECT fingerprint, min(finding_id) AS finding_id, arg_min(review_id, finding_id) AS review_id, arg_min(category, finding_id) AS category, arg_min(file, finding_id) AS file, max(conf) AS conf, min(level) AS level FROM e GROUP BY fingerprint),
    o AS (SELECT *, row_number() OVER (PARTITION BY review_id, level ORDER BY conf DESC, finding_id) AS k FROM c WHERE level > 1 AND category <> 'security'),
    p AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY level, conf DESC, finding_id) AS j FROM o WHERE k <= {CAP}),
    m AS (SELECT finding_id, review_id, category, conf, level FROM c WHERE level <= 1 OR category = 'security' UNION ALL SELECT finding_id, review_id, category, conf, level FROM p WHERE j <= 12)"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("finding_id")
    df = printed(spark, sf_dir).withColumns({"review_id": i % 40, "severity": F.concat(F.lit("P"), F.col("level").cast("string"))})
    return df.withColumn("category", F.when(i % 7 == 0, "security").otherwise(F.col("category")))


@query("merge_findings", f"WITH {MERGED} SELECT finding_id, review_id, category, conf, level, 'P' || level AS severity FROM m")
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.merge_findings(reviewed(spark, sf_dir)).select("finding_id", "review_id", "category", "conf", "level", "severity")


#: Verdicts: confirm, reject with and without a reason, revise with a body that is workings or not.
REASON = "CASE finding_id % 3 WHEN 0 THEN 'let me ' ELSE '' END || repeat('x', CAST(finding_id % 80 AS INT))"
VERDICTS = f"""v AS (SELECT finding_id, CASE finding_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'revise' END AS verdict, CASE WHEN finding_id % 8 <> 3 THEN CAST(finding_id % 6 AS INT) END AS new_level,
      CASE WHEN finding_id % 8 <> 0 THEN finding_id % 1000 END AS new_conf, {REASON} AS reason, CASE finding_id % 5 WHEN 1 THEN 'the finding is fine' WHEN 2 THEN ' ' ELSE 'better words' END AS new_body FROM f WHERE finding_id % 5 <> 0)"""
FOLD = "CASE WHEN verdict = 'confirm' AND new_conf IS NULL THEN least(1000, conf + 100) ELSE coalesce(new_conf, conf) END"
REJECTED = "coalesce(verdict = 'reject' AND length(trim(reason)) >= 40 AND NOT regexp_matches(trim(reason), '(?i)^let me '), false)"


def verdicts(df: DataFrame) -> DataFrame:
    i = F.col("finding_id")
    return df.filter("finding_id % 5 <> 0").select(
        "finding_id",
        F.when(i % 4 == 0, "confirm").when(i % 4 == 1, "reject").otherwise("revise").alias("verdict"),
        F.when(i % 8 != 3, (i % 6).cast("int")).alias("level"),
        F.when(i % 8 != 0, i % 1000).alias("conf"),
        F.concat(F.when(i % 3 == 0, "let me ").otherwise(""), F.repeat(F.lit("x"), (i % 80).cast("int"))).alias("reason"),
        F.when(i % 5 == 1, "the finding is fine").when(i % 5 == 2, " ").otherwise("better words").alias("body"),
    )


@query(
    "verify_fold",
    f"""WITH {FINDINGS}, {VERDICTS} SELECT f.finding_id, review_id, category, CASE WHEN verdict = 'revise' THEN coalesce(new_level, level) ELSE level END AS level, CASE WHEN verdict = 'revise' AND new_level IS NOT NULL THEN 'P' || new_level ELSE severity END AS severity, {FOLD} AS conf,
      CASE WHEN verdict = 'revise' AND trim(new_body) = 'better words' THEN 'better words' ELSE 'first words' END AS body, CASE WHEN {REJECTED} THEN 'rejected' ELSE 'kept' END AS status FROM f LEFT JOIN v USING (finding_id)""",
)
def verify_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = findings(spark, sf_dir).withColumn("body", F.lit("first words"))
    return O.verify_fold(df, verdicts(df))


FINAL = f"""{MERGED}, f AS (SELECT finding_id FROM m), {VERDICTS},
    a AS (SELECT m.*, CASE WHEN finding_id % 3 = 0 THEN (finding_id % 26 + 75) / 100.0::DOUBLE END AS sim, finding_id % 2 = 0 AS known FROM m),
    b AS (SELECT *, CASE WHEN sim >= CASE WHEN category = 'security' THEN 0.97::DOUBLE ELSE 0.92::DOUBLE END AND (category <> 'security' OR known) THEN 'suppressed' WHEN sim >= 0.80::DOUBLE THEN 'downranked' ELSE 'kept' END AS memory FROM a),
    g AS (SELECT * EXCLUDE (conf), CASE WHEN memory = 'downranked' THEN (conf * 600 + 500) // 1000 ELSE conf END AS conf FROM b),
    h AS (SELECT * EXCLUDE (conf), CASE WHEN memory <> 'suppressed' AND category = 'en' THEN (conf * 800 + 500) // 1000 ELSE conf END AS conf FROM g),
    w AS (SELECT h.*, v.* EXCLUDE (finding_id) FROM h LEFT JOIN v ON h.finding_id = v.finding_id AND memory <> 'suppressed' AND (category = 'security' OR (level <= 1 AND conf < 750))),
    x AS (SELECT finding_id, review_id, category, CASE WHEN verdict = 'revise' THEN coalesce(new_level, level) ELSE level END AS level, {FOLD} AS conf, memory, {REJECTED} AS rejected FROM w),
    final AS (SELECT finding_id, review_id, category, CAST(level AS INT) AS level, CAST(conf AS BIGINT) AS conf, CASE WHEN memory = 'suppressed' THEN memory WHEN rejected THEN 'rejected' ELSE memory END AS status FROM x WHERE memory = 'suppressed' OR rejected OR ((category = 'security' OR level <= 4) AND conf >= 350))"""


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, i = reviewed(spark, sf_dir), F.col("finding_id")
    matched = df.filter("finding_id % 3 = 0").select("finding_id", ((i % 26 + 75) / F.lit(100.0)).alias("similarity"), F.when(i % 2 == 0, "known").otherwise(" ").alias("reason"))
    stats = spark.createDataFrame([("en", 800)], "category string, correction long")
    # level 5 is under the floor of 4 at the end, the merge takes all
    merged = R.finalize(df, matched, verdicts(df), stats, 5)
    return merged.filter("status in ('suppressed', 'rejected') or category = 'security' or level <= 4")


@query("finalize_review", f"WITH {FINAL} SELECT * FROM final")
def finalize_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalized(spark, sf_dir).select("finding_id", "review_id", "category", "level", "conf", "status")


@query(
    "review_summary",
    f"""WITH {FINAL}, r AS (SELECT unnest(range(45)) AS review_id), q AS (SELECT review_id, 60 + review_id % 41 AS coverage FROM r), y AS (SELECT *, CASE level WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 2 END AS wt FROM final WHERE status IN ('kept', 'downranked')),
    z AS (SELECT review_id, count(*) AS findings, min(level) AS worst, sum(wt * conf) AS wc, sum(wt) AS wt FROM y GROUP BY review_id), u AS (SELECT review_id, count(*) AS suppressed FROM final WHERE status = 'suppressed' GROUP BY review_id)
    SELECT q.review_id, CASE WHEN worst <= 1 THEN 'request_changes' WHEN worst IS NOT NULL THEN 'comment' ELSE 'approve' END AS verdict, CAST(CASE WHEN worst IS NULL THEN CASE WHEN coverage >= 80 THEN 5 ELSE 4 END ELSE greatest(1, least(worst + 1, 4) - CASE WHEN coverage < 80 THEN 1 ELSE 0 END) END AS INT) AS score,
      CAST(CASE WHEN wt IS NULL THEN 6 * coverage + 400 ELSE (2 * wc * coverage + 100 * wt) // (200 * wt) END AS BIGINT) AS confidence, coalesce(findings, 0) AS findings, coalesce(suppressed, 0) AS suppressed FROM q LEFT JOIN z USING (review_id) LEFT JOIN u USING (review_id)""",
)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = spark.range(45).select(F.col("id").alias("review_id"), (60 + F.col("id") % 41).alias("coverage"))
    return R.summary(finalized(spark, sf_dir), cover)


@query("suppressed_count", f"WITH {FINAL} SELECT count(*) AS findings, count(*) FILTER (status = 'suppressed') AS suppressed FROM final")
def suppressed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppressed_count(finalized(spark, sf_dir))


@query("finding_lines", f"WITH {PRINTED} SELECT finding_id, '- [P' || level || '] ' || file || ': t' || line || ' (confidence ' || (conf + 5) // 1000 || '.' || lpad(CAST(((conf + 5) // 10) % 100 AS VARCHAR), 2, '0') || ')' AS brief, category = 'en' AND finding_id % 2 = 0 AS note FROM d")
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = printed(spark, sf_dir).withColumns({"severity": F.concat(F.lit("P"), F.col("level").cast("string")), "title": F.concat(F.lit("t"), F.col("line").cast("string")), "category": F.when(F.col("category") == "en", "security").otherwise(F.col("category"))})
    return R.brief(df.withColumn("app_code", F.col("finding_id") % 2 == 1)).select("finding_id", "brief", "note")


@query("finding_markdown", f"WITH {PRINTED} SELECT finding_id, '**P' || level || '** ' || fingerprint || chr(10) || chr(10) || file || CASE WHEN line > 9 THEN chr(10) || chr(10) || '```suggestion' || chr(10) || line || chr(10) || '```' ELSE '' END AS markdown FROM d")
def finding_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.when(F.col("line") > 9, F.col("line").cast("string"))
    df = printed(spark, sf_dir).select("finding_id", F.concat(F.lit("P"), F.col("level").cast("string")).alias("severity"), F.col("fingerprint").alias("title"), F.col("file").alias("body"), patch.alias("patch"))
    return R.finding_body(df).select("finding_id", "markdown")


@query(
    "merged_answers",
    f"""WITH {PRINTED}, o AS (SELECT finding_id % 40 AS review_id, 'title ' || finding_id % 90 AS key, arg_max(file, finding_id) AS file, arg_max(category, finding_id) AS category, arg_max(conf, finding_id) AS conf, arg_max(level, finding_id) AS level FROM d GROUP BY ALL),
    a AS (SELECT finding_id % 40 AS review_id, finding_id AS ordinal, 'title ' || finding_id % 110 AS key, CASE WHEN finding_id % 3 = 0 THEN 'own' END AS file, CASE WHEN finding_id % 4 = 0 THEN '' ELSE 'bug' END AS category, CASE WHEN finding_id % 5 = 0 THEN finding_id % 1000 END AS conf, 'p' || finding_id % 9 AS severity FROM d)
    SELECT a.review_id, ordinal, 'TITLE ' || substr(a.key, 7) AS title, coalesce(a.file, o.file, 'unknown') AS file, coalesce(nullif(a.category, ''), o.category, 'bug') AS category, CAST(CASE WHEN ordinal % 9 < 6 THEN ordinal % 9 ELSE 3 END AS INT) AS level,
      CAST(coalesce(a.conf, o.conf, 500) AS BIGINT) AS conf, CAST(coalesce(o.level, CASE WHEN ordinal % 9 < 6 THEN ordinal % 9 ELSE 3 END) AS INT) AS model_level FROM a LEFT JOIN o ON a.review_id = o.review_id AND a.key = o.key""",
)
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("finding_id")
    df = printed(spark, sf_dir).withColumns({"review_id": i % 40, "title": F.concat(F.lit("Title "), (i % 90).cast("string"))})
    answers = df.select(
        "review_id", i.alias("ordinal"), F.concat(F.lit(" TITLE "), (i % 110).cast("string")).alias("title"), F.when(i % 3 == 0, "own").alias("file"), F.when(i % 4 == 0, "").otherwise("bug").alias("category"),
        F.when(i % 5 == 0, i % 1000).alias("conf"), F.concat(F.lit("p"), (i % 9).cast("string")).alias("severity"),
    )
    return R.rebuilt(answers, df)
