"""Analytics, feedback and queue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query
from tallyforge.operators import memory as M
from tallyforge.operators import queue as Q
from tallyforge.operators import stats as S
from tallyforge.sources.tables import table

CALLS = """c AS (SELECT l_orderkey AS review_id, l_returnflag AS prompt, CAST(l_quantity AS BIGINT) AS tokens_in, l_partkey % 17 AS tokens_out, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents,
    CASE WHEN l_partkey % 9 > 0 THEN CAST(round(l_discount * 100) * l_quantity AS BIGINT) // 100 END AS tokens_cached, l_partkey AS request_hash, CASE WHEN l_linestatus = 'O' THEN l_shipmode_ END AS version, l_linestatus = 'O' OR l_suppkey % 3 <> 0 AS ok, l_suppkey AS response, l_shipdate AS ts,
    l_orderkey * 1000000 + l_partkey AS call_id FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS l_shipmode_ FROM lineitem))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as the call log."""
    c = F.col
    version = F.when(c("l_partkey") % 2 == 0, "v1").otherwise("v2")
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("review_id"),
        c("l_returnflag").alias("prompt"),
        c("l_quantity").cast("long").alias("tokens_in"),
        F.round(c("l_extendedprice") * 100).cast("long").alias("cost_cents"),
        (c("l_partkey") % 17).alias("tokens_out"),
        F.when(c("l_partkey") % 9 > 0, F.floor((F.round(c("l_discount") * 100) * c("l_quantity")).cast("long") / 100).cast("long")).alias("tokens_cached"),
        c("l_partkey").alias("request_hash"),
        F.when(c("l_linestatus") == "O", version).alias("version"),
        ((c("l_linestatus") == "O") | (c("l_suppkey") % 3 != 0)).alias("ok"),
        c("l_suppkey").alias("response"),
        c("l_shipdate").alias("ts"),
        (c("l_orderkey") * 1000000 + c("l_partkey")).alias("call_id"),
    )


SPEND = "count(*) AS calls, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, CAST(coalesce(sum(tokens_cached), 0) AS BIGINT) AS tokens_cached"


@query("spend_totals", f"WITH {CALLS} SELECT {SPEND} FROM c")
def spend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spend(calls(spark, sf_dir), [])


@query("spend_by_prompt", f"WITH {CALLS} SELECT prompt, {SPEND} FROM c GROUP BY prompt")
def spend_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spend(calls(spark, sf_dir), ["prompt"])


@query("spend_per_review", f"WITH {CALLS} SELECT review_id, {SPEND} FROM c GROUP BY review_id")
def spend_per_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spend(calls(spark, sf_dir), ["review_id"])


@query("cache_hit_rate", f"WITH {CALLS} SELECT CAST(1000 * sum(tokens_cached) // sum(tokens_in) AS BIGINT) AS cache_rate FROM c")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_rate(calls(spark, sf_dir))


@query(
    "latest_answer",
    f"WITH {CALLS} SELECT request_hash, version, review_id, max(call_id) AS call_id, max(struct_pack(c := call_id, r := response)).r AS response FROM c WHERE ok AND response IS NOT NULL GROUP BY request_hash, version, review_id",
)
def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_answer(calls(spark, sf_dir)).select("request_hash", "version", "review_id", "call_id", "response")


@query(
    "answer_reuse",
    f"""WITH {CALLS}, a AS (SELECT request_hash, version, review_id, max(call_id) AS reused FROM c WHERE ok GROUP BY ALL), r AS (SELECT DISTINCT request_hash, version, review_id FROM c)
    SELECT r.request_hash, r.version, r.review_id, a.reused FROM r LEFT JOIN a ON r.request_hash = a.request_hash AND r.version IS NOT DISTINCT FROM a.version AND r.review_id IS NOT DISTINCT FROM a.review_id""",
)
def answer_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    return S.reuse(c.select("request_hash", "version", "review_id").distinct(), c).drop("response")


@query(
    "budget_prefix_calls",
    f"WITH {CALLS}, u AS (SELECT review_id, call_id, cost_cents FROM c), s AS (SELECT *, CAST(coalesce(sum(cost_cents) OVER (PARTITION BY review_id ORDER BY call_id, cost_cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM u) SELECT * FROM s WHERE spent_before < 8000000",
)
def budget_prefix_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.budget_prefix(calls(spark, sf_dir).select("review_id", "call_id", "cost_cents"), 8_000_000)


@query(
    "budget_tokens_deadline",
    """WITH c AS (SELECT o_custkey AS review_id, o_orderkey AS call_id, 1 AS cost_cents, o_orderkey % 700 AS tokens_in, o_orderkey % 90 AS tokens_out, o_orderkey AS t FROM orders),
    s AS (SELECT *, CAST(coalesce(sum(cost_cents) OVER w, 0) AS BIGINT) AS spent_before, CAST(coalesce(sum(tokens_in + tokens_out) OVER w, 0) AS BIGINT) AS tokens_before, t - min(t) OVER (PARTITION BY review_id) AS elapsed FROM c WINDOW w AS (PARTITION BY review_id ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT review_id, call_id, spent_before, tokens_before, elapsed FROM s WHERE spent_before < 8 AND tokens_before < 2000 AND elapsed < 9000""",
)
def budget_tokens_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: orders as a customer's calls, under all three limits."""
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review_id"), k.alias("call_id"), F.lit(1).alias("cost_cents"), (k % 700).alias("tokens_in"), (k % 90).alias("tokens_out"), k.alias("at"))
    return S.budget_prefix(c, 8, 2000, 9000).select("review_id", "call_id", "spent_before", "tokens_before", "elapsed")


@query("spend_order", f"WITH {CALLS} SELECT prompt, {SPEND}, CAST(row_number() OVER (ORDER BY sum(cost_cents) DESC, prompt) AS INT) AS place FROM c GROUP BY prompt")
def spend_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spend_order(calls(spark, sf_dir))


@query("retention_trim", "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def retention_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retention(table(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00").select("event_id", "ts", "event_type")


@query("tally_by_category", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def tally_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tally(table(spark, sf_dir, "documents"), "source")


@query("files_per_language", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def files_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tally(table(spark, sf_dir, "documents"), "lang")


COUNTED = ["customer", "orders", "lineitem", "documents", "pages"]


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COUNTED))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table_counts({t: table(spark, sf_dir, t) for t in COUNTED})


FEEDBACK = """f AS (SELECT doc_id AS feedback_id, doc_id AS finding_id, source AS category, CASE WHEN quality = 1 THEN 'accept' WHEN doc_id % 4 = 0 THEN 'dismiss' WHEN doc_id % 4 = 1 THEN 'style_rule' ELSE 'false_positive' END AS action, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS author,
    CASE WHEN toxic = 1 THEN 3 ELSE 10 END AS weight10, sha256(text) AS fingerprint FROM labels JOIN documents USING (doc_id))"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labels` on `documents` as feedback on findings."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    i = F.col("doc_id")
    return j.select(
        i.alias("feedback_id"),
        i.alias("finding_id"),
        F.col("source").alias("category"),
        F.when(F.col("quality") == 1, "accept").when(i % 4 == 0, "dismiss").when(i % 4 == 1, "style_rule").otherwise("false_positive").alias("action"),
        F.when(i % 7 != 0, F.col("lang")).alias("author"),
        F.when(F.col("toxic") == 1, 3).otherwise(10).cast("long").alias("weight10"),
        F.sha2("text", 256).alias("fingerprint"),
    )


CALIBRATION = f"""WITH {FEEDBACK}, p AS (SELECT category, action, sum(weight10) * (4 + least(count(DISTINCT coalesce(author, CAST(feedback_id AS VARCHAR))) - 1, 4)) AS w FROM f WHERE action IN ('accept', 'false_positive') GROUP BY category, action),
    s AS (SELECT category, CAST(coalesce(sum(w) FILTER (action = 'accept'), 0) AS BIGINT) AS accepted40, CAST(coalesce(sum(w) FILTER (action <> 'accept'), 0) AS BIGINT) AS rejected40 FROM p GROUP BY category),
    q AS (SELECT *, accepted40 + rejected40 AS events40, CAST(1000 * rejected40 // greatest(accepted40 + rejected40, 1) AS BIGINT) AS fp_rate FROM s),
    k AS (SELECT *, CAST(CASE WHEN events40 < 200 THEN 1000 ELSE greatest(500, 1000 - fp_rate) END AS BIGINT) AS correction FROM q)"""


@query("calibration_stats", f"{CALIBRATION} SELECT * FROM k")
def calibration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration(feedback(spark, sf_dir))


@query("calibration_report", f"{CALIBRATION} SELECT *, CAST(row_number() OVER (ORDER BY events40 DESC, category) AS INT) AS place FROM k")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_report(M.calibration(feedback(spark, sf_dir)))


@query(
    "calibrated_findings",
    f"""{CALIBRATION} SELECT doc_id AS finding_id, source AS category, CASE WHEN coalesce(correction, 1000) <> 1000 THEN n_chars % 1000 END AS stated_conf, CAST(((n_chars % 1000) * coalesce(correction, 1000) + 500) // 1000 AS BIGINT) AS conf
    FROM documents LEFT JOIN k ON source = k.category""",
)
def calibrated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("finding_id"), F.col("source").alias("category"), (F.col("n_chars") % 1000).alias("conf"))
    return M.calibrate(found, M.calibration(feedback(spark, sf_dir)))


@query(
    "suppressors_dedup",
    f"WITH {FEEDBACK} SELECT finding_id // 3 AS finding_id, CAST(sum(weight10) AS BIGINT) AS weight10, arg_min(fingerprint, feedback_id) AS fingerprint, arg_min(action, feedback_id) AS action, arg_min(coalesce(author, '-'), feedback_id) AS author FROM f WHERE action IN ('false_positive', 'dismiss') GROUP BY finding_id // 3",
)
def suppressors_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feedback(spark, sf_dir).withColumn("finding_id", F.floor(F.col("finding_id") / 3).cast("long")).withColumn("author", F.coalesce("author", F.lit("-")))
    return M.suppressors(f)


@query(
    "fingerprint_suppressed",
    f"WITH {FEEDBACK}, s AS (SELECT fingerprint, max(finding_id) AS suppressor FROM f WHERE action IN ('false_positive', 'dismiss') GROUP BY fingerprint) SELECT doc_id AS finding_id, suppressor FROM documents JOIN s ON sha256(text) = s.fingerprint",
)
def fingerprint_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("finding_id"), F.sha2("text", 256).alias("fingerprint"))
    return M.fingerprint_match(found, M.suppressors(feedback(spark, sf_dir)))


VECTORS = "v AS (SELECT vec_id AS key, CAST(label AS VARCHAR) AS category, embedding AS vector FROM embeddings)"
PAIRS = f"{VECTORS}, q AS (SELECT * FROM v WHERE key % 20 = 0), n AS (SELECT q.key, q.category, v.key AS neighbour, v.category AS neighbour_category, list_sum(list_transform(list_zip(q.vector, v.vector), lambda x: CAST((x[1] - x[2]) * (x[1] - x[2]) AS DOUBLE))) AS d2 FROM q JOIN v ON q.key <> v.key), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY d2, neighbour) AS INT) AS rank FROM n)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("category"), F.col("embedding").alias("vector"))


@query("knn_topk", f"WITH {PAIRS} SELECT key, neighbour, rank FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return M.knn(v.filter("key % 20 = 0"), v, 10).select("key", "neighbour", "rank")


@query("knn_category_postfilter", f"WITH {PAIRS} SELECT key, arg_min(neighbour, rank) AS suppressor FROM r WHERE rank <= 40 AND category = neighbour_category AND neighbour % 3 = 0 GROUP BY key")
def knn_category_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    near = M.knn(v.filter("key % 20 = 0"), v, M.NEIGHBOURS)
    return M.similarity_match(near, v.filter("key % 3 = 0").select(F.col("key").alias("finding_id"))).select("key", "suppressor")


@query(
    "match_precedence",
    f"""WITH {FEEDBACK}, s AS (SELECT fingerprint, max(finding_id) AS exact FROM f WHERE action IN ('false_positive', 'dismiss') GROUP BY fingerprint), e AS (SELECT doc_id AS finding_id, exact FROM documents JOIN s ON sha256(text) = s.fingerprint),
    n AS (SELECT doc_id AS finding_id, doc_id + 1 AS suppressor, (doc_id % 100) / 128.0::DOUBLE AS similarity FROM documents WHERE doc_id % 3 = 0)
    SELECT finding_id, coalesce(exact, suppressor) AS suppressor, CASE WHEN exact IS NOT NULL THEN 1.0::DOUBLE ELSE similarity END AS similarity, CASE WHEN exact IS NOT NULL THEN 'fingerprint' ELSE 'vector' END AS by FROM e FULL JOIN n USING (finding_id)""",
)
def match_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    found = d.select(i.alias("finding_id"), F.sha2("text", 256).alias("fingerprint"))
    near = d.filter("doc_id % 3 = 0").select(i.alias("key"), (i + 1).alias("suppressor"), ((i % 100) / F.lit(128.0)).alias("similarity"))
    return M.matches(found, near, M.suppressors(feedback(spark, sf_dir)))


@query(
    "suppress_or_downrank",
    """WITH f AS (SELECT o_orderkey AS finding_id, CASE WHEN o_orderstatus = 'P' THEN 'security' ELSE 'bug' END AS category, o_orderkey % 1000 AS conf, CASE WHEN o_orderkey % 11 > 0 THEN CAST(CAST(o_totalprice * 100 AS BIGINT) % 101 AS DOUBLE) / 100 END AS similarity, CASE WHEN o_custkey % 2 = 0 THEN 'known' ELSE ' ' END AS reason FROM orders),
    s AS (SELECT *, CASE WHEN similarity >= CASE WHEN category = 'security' THEN 0.97::DOUBLE ELSE 0.92::DOUBLE END AND (category <> 'security' OR length(trim(reason)) > 0) THEN 'suppressed' WHEN similarity >= 0.80::DOUBLE THEN 'downranked' ELSE 'kept' END AS status FROM f)
    SELECT finding_id, category, similarity, reason, status, CASE WHEN status = 'downranked' THEN CAST((conf * 600 + 500) // 1000 AS BIGINT) ELSE conf END AS conf FROM s""",
)
def suppress_or_downrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.operators.findings import memory_ladder

    o = table(spark, sf_dir, "orders")
    similarity = ((F.col("o_totalprice") * 100).cast("decimal(18,0)").cast("long") % 101).cast("double") / 100
    return memory_ladder(
        o.select(
            F.col("o_orderkey").alias("finding_id"),
            F.when(F.col("o_orderstatus") == "P", "security").otherwise("bug").alias("category"),
            (F.col("o_orderkey") % 1000).alias("conf"),
            F.when(F.col("o_orderkey") % 11 > 0, similarity).alias("similarity"),
            F.when(F.col("o_custkey") % 2 == 0, "known").otherwise(" ").alias("reason"),
        )
    )


JOBS = """j AS (SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'index' WHEN 'error' THEN 'github_comment' ELSE 'other' END AS kind,
    CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS status, CAST(user_id % 4 AS INT) AS attempts, CASE WHEN user_id % 2 = 0 THEN 'boom' END AS error FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("job_id"),
        F.when(t == "click", "review").when(t == "view", "index").when(t == "error", "github_comment").otherwise("other").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "running").otherwise("done").alias("status"),
        (F.col("user_id") % 4).cast("int").alias("attempts"),
        F.when(F.col("user_id") % 2 == 0, "boom").alias("error"),
    )


@query("queue_claim", f"WITH {JOBS} SELECT job_id, kind, 'running' AS status, attempts + 1 AS attempts, error FROM j WHERE job_id = (SELECT min(job_id) FROM j WHERE status = 'queued')")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claim(jobs(spark, sf_dir))


@query(
    "retry_transition",
    f"WITH {JOBS} SELECT job_id, kind, attempts, error, CASE WHEN status <> 'running' THEN status WHEN error IS NULL THEN 'done' WHEN attempts < CASE kind WHEN 'review' THEN 1 WHEN 'index' THEN 3 WHEN 'github_review' THEN 1 WHEN 'github_comment' THEN 3 ELSE 1 END THEN 'queued' ELSE 'failed' END AS status FROM j",
)
def retry_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.finish(jobs(spark, sf_dir))


@query(
    "recover_orphans",
    f"WITH {JOBS}, k AS (SELECT *, status = 'running' AS r, attempts < CASE kind WHEN 'index' THEN 3 WHEN 'github_comment' THEN 3 ELSE 1 END AS again FROM j) SELECT job_id, kind, attempts, CASE WHEN r AND again THEN 'queued' WHEN r THEN 'failed' ELSE status END AS status, CASE WHEN r AND NOT again THEN 'interrupted by a restart; not repeated automatically' ELSE error END AS error FROM k",
)
def recover_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.recover(jobs(spark, sf_dir))


@query("review_upsert", "SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS created_at FROM orders")
def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("old").alias("status"), F.col("o_orderdate").alias("created_at"))
    new = o.filter("review_id % 3 = 0 or review_id % 2 = 0").withColumns({"status": F.lit("new"), "created_at": F.lit("2030-01-01").cast("timestamp_ntz")})
    return Q.upsert_reviews(o.filter("review_id % 2 = 1"), new)


@query("key_allocation", "SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY doc_id) AS key, doc_id FROM documents")
def key_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return Q.allocate(old, table(spark, sf_dir, "documents").select("doc_id"), "key", ["doc_id"])


PULLS = """p AS (SELECT o_orderkey AS number, o_orderstatus = 'P' AS draft, CASE o_custkey % 3 WHEN 0 THEN 'us/it' WHEN 1 THEN 'them/it' END AS head_repo, 'us/it' AS base_repo, 'sha' || o_orderkey % 5 AS head_sha FROM orders),
    k AS (SELECT *, CASE WHEN draft THEN 'draft' WHEN head_repo IS DISTINCT FROM base_repo THEN 'fork' END AS skipped FROM p)"""


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 3
    return Q.skip_review(table(spark, sf_dir, "orders").select(k.alias("number"), (F.col("o_orderstatus") == "P").alias("draft"), F.when(c == 0, "us/it").when(c == 1, "them/it").alias("head_repo"), F.lit("us/it").alias("base_repo"), F.concat(F.lit("sha"), (k % 5).cast("string")).alias("head_sha")))


@query("skipped_pulls", f"WITH {PULLS} SELECT number, skipped FROM k")
def skipped_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulls(spark, sf_dir).select("number", "skipped")


@query("wanted_reviews", f"WITH {PULLS}, s AS (SELECT o_orderkey AS number, CASE WHEN o_orderkey % 7 > 1 THEN 'sha' || o_orderkey % 3 END AS reviewed_sha FROM orders WHERE o_orderkey % 2 = 0) SELECT number, head_sha, CASE WHEN reviewed_sha IS NULL THEN 'opened' ELSE 'synchronize' END AS event FROM k LEFT JOIN s USING (number) WHERE skipped IS NULL AND reviewed_sha IS DISTINCT FROM head_sha")
def wanted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = table(spark, sf_dir, "orders").filter(k % 2 == 0).select(k.alias("number"), F.when(k % 7 > 1, F.concat(F.lit("sha"), (k % 3).cast("string"))).alias("reviewed_sha"))
    return Q.wants_review(pulls(spark, sf_dir), state).select("number", "head_sha", "event")


@query("remembered_counts", "WITH n AS (SELECT user_id AS comment_id, event_type AS kind, count(*) AS c, count(*) FILTER (user_id % 3 > 0 AND ts < TIMESTAMP '2024-01-20') AS b FROM events GROUP BY ALL), a AS (SELECT user_id AS comment_id, event_type AS kind, count(*) AS w FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL) SELECT comment_id, kind, w AS count FROM a WHERE comment_id % 3 = 0 UNION ALL SELECT comment_id, kind, c FROM n WHERE comment_id % 3 > 0")
def remembered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("comment_id"), F.col("event_type").alias("kind"), "ts")
    count = lambda df: df.groupBy("comment_id", "kind").agg(F.count(F.lit(1)).alias("count"))
    return Q.merged_counts(count(e.filter("ts < timestamp_ntz '2024-01-20 00:00:00'")), count(e.filter("comment_id % 3 > 0")))


@query(
    "reaction_delta",
    "WITH n AS (SELECT user_id AS comment_id, event_type AS kind, count(*) AS c, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS b FROM events GROUP BY ALL) SELECT comment_id, kind, c - b AS delta FROM n WHERE c > b",
)
def reaction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("comment_id"), F.col("event_type").alias("kind"), "ts")
    count = lambda df: df.groupBy("comment_id", "kind").agg(F.count(F.lit(1)).alias("count"))
    return Q.reaction_deltas(count(e.filter("ts < timestamp_ntz '2024-01-20 00:00:00'")), count(e))


@query("keep_first_duplicate", "SELECT doc_id, text_sha FROM (SELECT doc_id, sha256(text) AS text_sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def keep_first_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return Q.keep_first(d, ["text_sha"], ["doc_id"])


@query("latest_wins_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return Q.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


@query(
    "changed_files",
    """WITH b AS (SELECT 'p' || doc_id AS path, sha256(text) AS blob FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'q' ELSE 'p' END || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS blob FROM documents WHERE doc_id % 4 <> 0),
    g AS (SELECT path, blob, row_number() OVER (PARTITION BY blob ORDER BY path) AS k FROM b WHERE path NOT IN (SELECT path FROM a)), n AS (SELECT path, blob, row_number() OVER (PARTITION BY blob ORDER BY path) AS k FROM a WHERE path NOT IN (SELECT path FROM b)),
    r AS (SELECT n.path, g.path AS old_path FROM g JOIN n ON g.blob = n.blob AND g.k = n.k)
    SELECT path, old_path, 'R' AS status FROM r UNION ALL SELECT a.path, NULL, 'M' FROM a JOIN b USING (path) WHERE a.blob <> b.blob
    UNION ALL SELECT path, NULL, 'A' FROM n WHERE path NOT IN (SELECT path FROM r) UNION ALL SELECT path, NULL, 'D' FROM g WHERE path NOT IN (SELECT old_path FROM r)""",
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    before = d.filter("doc_id % 5 <> 0").select(F.concat(F.lit("p"), i.cast("string")).alias("path"), F.sha2("text", 256).alias("blob"))
    after = d.filter("doc_id % 4 <> 0").select(
        F.concat(F.when(i % 7 == 0, "q").otherwise("p"), i.cast("string")).alias("path"), F.when(i % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("blob")
    )
    return Q.changed_files(before, after)


@query(
    "comment_watermark",
    "WITH m AS (SELECT conv_id, max(turn) // 2 AS mark FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id) SELECT conv_id AS number, turn AS id, role AS author FROM conversations JOIN m USING (conv_id) WHERE turn > mark",
)
def comment_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("number"), F.col("turn").alias("id"), F.col("role").alias("author"))
    marks = c.filter("number % 3 <> 0").groupBy("number").agg(F.floor(F.max("id") / 2).cast("long").alias("mark"))
    return Q.comment_marks(c, marks)[0]


@query(
    "command_parse",
    """WITH b AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '@bot Review ' WHEN 1 THEN '@bottle review ' ELSE 'ask @bot: ' END || text AS t FROM conversations)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'review' WHEN 1 THEN NULL ELSE 'other' END AS command, length(t) AS n_chars FROM b""",
)
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") % 3
    body = F.concat(F.when(t == 0, "@bot Review ").when(t == 1, "@bottle review ").otherwise("ask @bot: "), "text")
    return c.select("conv_id", "turn", Q.command(body, "bot").alias("command"), F.length(body).cast("long").alias("n_chars"))
